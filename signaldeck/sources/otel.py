"""Decoded OpenTelemetry export batches as nested rows.

Input files hold one export request per row (JSON lines or Parquet).  The schema is
explicit; attribute values are typed one-of structs whose arrays and key-value lists
are kept as JSON text, which the operators decode at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions.stage import staged


def any_value_ddl() -> str:
    """One-of value: exactly one member is set; nested values are JSON text.

    Numbers are text, as requests may write them either way.
    """
    return (
        "struct<string_value: string, bool_value: boolean, int_value: string, "
        "double_value: string, bytes_value: binary, array_value: string, kvlist_value: string>"
    )


ATTRIBUTES = f"array<struct<key: string, value: {any_value_ddl()}>>"
RESOURCE = (
    f"struct<attributes: {ATTRIBUTES}, dropped_attributes_count: bigint, "
    "entity_refs: array<struct<schema_url: string, type: string, id_keys: array<string>, "
    "description_keys: array<string>>>>"
)
SCOPE = (
    f"struct<name: string, version: string, attributes: {ATTRIBUTES}, dropped_attributes_count: bigint>"
)
EVENT = (
    f"struct<time_unix_nano: bigint, name: string, attributes: {ATTRIBUTES}, "
    "dropped_attributes_count: bigint>"
)
LINK = (
    f"struct<trace_id: binary, span_id: binary, trace_state: string, attributes: {ATTRIBUTES}, "
    "dropped_attributes_count: bigint, flags: bigint>"
)
SPAN = (
    "struct<trace_id: binary, span_id: binary, trace_state: string, parent_span_id: binary, "
    "flags: bigint, name: string, kind: int, start_time_unix_nano: bigint, "
    f"end_time_unix_nano: bigint, attributes: {ATTRIBUTES}, dropped_attributes_count: bigint, "
    f"events: array<{EVENT}>, dropped_events_count: bigint, links: array<{LINK}>, "
    "dropped_links_count: bigint, status: struct<code: int, message: string>>"
)
LOG = (
    "struct<time_unix_nano: bigint, observed_time_unix_nano: bigint, severity_number: int, "
    f"severity_text: string, body: {any_value_ddl()}, attributes: {ATTRIBUTES}, "
    "dropped_attributes_count: bigint, flags: bigint, trace_id: binary, span_id: binary, "
    "event_name: string>"
)
EXEMPLAR = (
    f"struct<filtered_attributes: {ATTRIBUTES}, time_unix_nano: bigint, span_id: binary, "
    "trace_id: binary, as_double: double, as_int: bigint>"
)
POINT = f"attributes: {ATTRIBUTES}, start_time_unix_nano: bigint, time_unix_nano: bigint, flags: bigint"
NUMBER_POINT = f"struct<{POINT}, as_double: double, as_int: bigint, exemplars: array<{EXEMPLAR}>>"
HISTOGRAM_POINT = (
    f"struct<{POINT}, count: bigint, sum: double, bucket_counts: array<bigint>, "
    f"explicit_bounds: array<double>, min: double, max: double, exemplars: array<{EXEMPLAR}>>"
)
BUCKETS = "struct<offset: int, bucket_counts: array<bigint>>"
EXPONENTIAL_POINT = (
    f"struct<{POINT}, count: bigint, sum: double, scale: int, zero_count: bigint, "
    f"positive: {BUCKETS}, negative: {BUCKETS}, min: double, max: double, "
    f"zero_threshold: double, exemplars: array<{EXEMPLAR}>>"
)
SUMMARY_POINT = (
    f"struct<{POINT}, count: bigint, sum: double, "
    "quantile_values: array<struct<quantile: double, value: double>>>"
)
METRIC = (
    f"struct<name: string, description: string, unit: string, metadata: {ATTRIBUTES}, "
    f"gauge: struct<data_points: array<{NUMBER_POINT}>>, "
    f"sum: struct<data_points: array<{NUMBER_POINT}>, aggregation_temporality: int, is_monotonic: boolean>, "
    f"histogram: struct<data_points: array<{HISTOGRAM_POINT}>, aggregation_temporality: int>, "
    f"exponential_histogram: struct<data_points: array<{EXPONENTIAL_POINT}>, aggregation_temporality: int>, "
    f"summary: struct<data_points: array<{SUMMARY_POINT}>>>"
)


def _batches(item: str, items: str, scope_items: str) -> str:
    scoped = f"array<struct<scope: {SCOPE}, schema_url: string, {items}: array<{item}>>>"
    return f"array<struct<resource: {RESOURCE}, schema_url: string, {scope_items}: {scoped}>>"


# kind -> (top-level column, scope-level column, item column)
LEVELS = {
    "traces": ("resource_spans", "scope_spans", "spans"),
    "logs": ("resource_logs", "scope_logs", "log_records"),
    "metrics": ("resource_metrics", "scope_metrics", "metrics"),
}
ITEMS = {"traces": SPAN, "logs": LOG, "metrics": METRIC}


def otel_ddl(kind: str) -> str:
    """Schema of one export request."""
    top, scoped, items = LEVELS[kind]
    return f"{top} {_batches(ITEMS[kind], items, scoped)}"


def with_arrival(df: DataFrame, project_id: int | Column | None, received_at_ms: int | Column | None) -> DataFrame:
    """Add the tenant and the arrival time where the rows do not carry them."""
    extra = {}
    if project_id is not None:
        extra["project_id"] = _column(project_id)
    if received_at_ms is not None:
        extra["received_at_ms"] = _column(received_at_ms)
    elif "received_at_ms" not in df.columns:
        extra["received_at_ms"] = F.unix_millis(F.current_timestamp())
    return df.withColumns(extra) if extra else df


def _column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def _inlined(text: Column) -> Column:
    """JSON text in which nested values that are texts of JSON are that JSON."""
    # Without escaped quotes a text ends at the next quote; JSON holds no such characters itself.
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    restored = lambda part: F.replace(F.replace(part, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    nested = r'^"(?:array|kvlist)_value":(?=")'
    parts = F.regexp_extract_all(marked, F.lit(r'"(?:array|kvlist)_value":"[^"]*"|"[^"]*"|[^"]+'), F.lit(0))
    return F.array_join(
        F.transform(
            parts,
            lambda part: F.when(
                part.rlike(nested),
                F.concat(
                    F.regexp_extract(part, r'^"[a-z]+_value":', 0),
                    F.coalesce(F.try_variant_get(F.try_parse_json(restored(F.regexp_replace(part, nested, ""))), "$", "string"), F.lit("null")),
                ),
            ).otherwise(restored(part)),
        ),
        "",
    )


# 64-bit integers that JSON requests may write as text; a quote within a text is escaped and never ends a name.
_QUOTED = (
    r'"((?:start_|end_|observed_)?time_unix_nano|as_int|count|zero_count|dropped_[a-z]+_count|flags)"(\s*:\s*)"(-?[0-9]+)"'
)


def bare_integers(text: Column) -> Column:
    """JSON text of a request with its decimal texts of integer members as numbers."""
    text = F.regexp_replace(text, _QUOTED, '"$1"$2$3')
    lists = F.array_distinct(F.regexp_extract_all(text, F.lit(r'"bucket_counts"\s*:\s*\[[-0-9\s,"]*"[-0-9\s,"]*\]'), F.lit(0)))
    bare = lambda part: F.concat(F.lit('"bucket_counts":'), F.regexp_replace(F.regexp_extract(part, r"\[.*", 0), '"', ""))
    return F.reduce(lists, text, lambda whole, part: F.replace(whole, part, bare(part)))


def read_otel(spark: SparkSession, path: str, kind: str, project_id: int,
              received_at_ms: int | None = None, format: str = "json") -> DataFrame:
    """Export requests of one kind ('traces', 'logs' or 'metrics'); JSON may write 64-bit integers as text."""
    if format == "json":
        lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
        rows = staged(lines, _r=F.from_json(bare_integers(F.col("value")), otel_ddl(kind))).select("_r.*")
    else:
        # Typed files hold nested values as structs to some depth, as text, or both.
        whole = _inlined(F.to_json(F.struct(LEVELS[kind][0])))
        rows = staged(spark.read.format(format).load(path), _r=F.from_json(whole, otel_ddl(kind))).select("_r.*")
    return with_arrival(rows, project_id, received_at_ms)


def scopes(batches: DataFrame, kind: str) -> DataFrame:
    """One row per (resource, scope) with its spans, log records or metrics as ``_items``."""
    top, scoped, leaf = LEVELS[kind]
    resource = batches.select("project_id", "received_at_ms", F.explode(top).alias("_r"))
    scope = resource.select(
        "project_id", "received_at_ms", F.col("_r.resource").alias("resource"),
        F.col("_r.schema_url").alias("resource_schema_url"), F.explode(f"_r.{scoped}").alias("_s"),
    )
    return scope.select(
        "project_id", "received_at_ms", "resource", "resource_schema_url",
        F.col("_s.scope").alias("scope"), F.col("_s.schema_url").alias("scope_schema_url"),
        F.col(f"_s.{leaf}").alias("_items"),
    )


def items(scope_rows: DataFrame, name: str) -> DataFrame:
    """One row per span, log record or metric, as column ``name``."""
    return scope_rows.select("*", F.explode("_items").alias(name)).drop("_items")
