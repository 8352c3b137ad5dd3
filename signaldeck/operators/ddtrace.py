"""Trace-agent spans -> trace records and error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.functions import variants as V
from signaldeck.schema import conform
from signaldeck.sources.ddtrace import spans

SOURCE = "ddtrace"
# Reject reasons.
INVALID_SPAN = "ddtrace.invalid_span"
MALFORMED = "malformed"


def with_dictionary_check(payloads: DataFrame) -> DataFrame:
    """Flag coded payloads whose indexes all lie inside their dictionary."""
    size = F.size("dictionary")
    inside = lambda index: F.coalesce((index >= 0) & (index < size), F.lit(False))
    number = lambda key: key.try_cast("bigint")

    def span_ok(span: Column) -> Column:
        meta = F.coalesce(span["meta"], F.create_map().cast("map<string, bigint>"))
        metrics = F.coalesce(span["metrics"], F.create_map().cast("map<string, double>"))
        return (
            inside(span["service"])
            & inside(span["name"])
            & inside(span["resource"])
            & inside(span["type"])
            & F.forall(F.map_entries(meta), lambda e: inside(number(e["key"])) & inside(e["value"]))
            & F.forall(F.map_keys(metrics), lambda key: inside(number(key)))
        )

    return payloads.withColumn("valid", F.forall(F.flatten("traces"), span_ok))


def expand_dictionary(payloads: DataFrame) -> DataFrame:
    """Coded payloads -> named spans; a payload with an index out of range is dropped.

    :func:`malformed_payloads` lists the dropped ones.
    """
    word = lambda index: F.get("dictionary", index.cast("int"))

    def named(span: Column) -> Column:
        return F.struct(
            word(span["service"]).alias("service"),
            word(span["name"]).alias("name"),
            word(span["resource"]).alias("resource"),
            *[span[c].alias(c) for c in ("trace_id", "span_id", "parent_id", "start", "duration", "error")],
            V.map_of_pairs(
                F.transform(
                    F.map_entries(span["meta"]),
                    lambda e: F.struct(word(e["key"]).alias("key"), word(e["value"]).alias("value")),
                ),
                "map<string,string>",
            ).alias("meta"),
            V.map_of_pairs(
                F.transform(
                    F.map_entries(span["metrics"]),
                    lambda e: F.struct(word(e["key"]).alias("key"), e["value"].alias("value")),
                ),
                "map<string,double>",
            ).alias("metrics"),
            word(span["type"]).alias("type"),
        )

    good = with_dictionary_check(payloads).filter("valid")
    expanded = F.transform("traces", lambda trace: F.transform(trace, named))
    return good.select("project_id", "received_at_ms", expanded.alias("traces"))


def malformed_payloads(payloads: DataFrame) -> DataFrame:
    """One row (project_id, reason) per coded payload with an index out of range."""
    bad = with_dictionary_check(payloads).filter(~F.coalesce("valid", F.lit(False)))
    return bad.select("project_id", F.lit(MALFORMED).alias("reason"))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def valid_span(span: Column) -> Column:
    """Non-zero ids, a name, start and duration not negative."""
    return (
        (_zero(span["trace_id"]) != 0)
        & (_zero(span["span_id"]) != 0)
        & (_text(span["name"]) != "")
        & (_zero(span["start"]) >= 0)
        & (_zero(span["duration"]) >= 0)
    )


def checked_spans(payloads: DataFrame) -> DataFrame:
    """One row per span with a ``valid`` flag."""
    return spans(payloads).withColumn("valid", valid_span(F.col("span")))


def rejects(payloads: DataFrame) -> DataFrame:
    """One row (project_id, reason) per invalid span."""
    bad = checked_spans(payloads).filter(~F.col("valid"))
    return bad.select("project_id", F.lit(INVALID_SPAN).alias("reason"))


def _keyed(payloads: DataFrame) -> DataFrame:
    span = F.col("span")
    meta = F.coalesce(span["meta"], F.create_map().cast("map<string, string>"))
    metrics = F.coalesce(span["metrics"], F.create_map().cast("map<string, double>"))
    rows = checked_spans(payloads).filter("valid").withColumns({"_meta": meta, "_metrics": metrics})
    rows = rows.withColumns(
        {
            "_trace": S.trace_id_128(span["trace_id"], F.col("_meta")["_dd.p.tid"]),
            "_span": S.hex16(span["span_id"]),
        }
    )
    return rows.withColumn("_id", F.concat_ws("-", "_trace", "_span"))


def _raw(span: Column) -> Column:
    return F.struct(
        *[_text(span[c]).alias(c) for c in ("service", "name", "resource")],
        # Unsigned 64-bit ids as decimal text.
        *[F.conv(F.hex(_zero(span[c])), 16, 10).alias(c) for c in ("trace_id", "span_id", "parent_id")],
        *[_zero(span[c]).alias(c) for c in ("start", "duration", "error")],
        F.col("_meta").alias("meta"),
        F.transform_values("_metrics", lambda _, v: F.when(S.is_finite(v), v)).alias("metrics"),
        _text(span["type"]).alias("type"),
    )


def _span_columns() -> dict[str, Column]:
    span, meta = F.col("span"), F.col("_meta")
    resource = F.nullif(_text(span["resource"]), F.lit(""))
    return {
        "id": F.col("_id"),
        "source_id": F.col("_id"),
        "signal": F.lit("trace"),
        "ts_nano": _zero(span["start"]),
        "name": span["name"],
        "message": F.coalesce(resource, span["name"]),
        "trace_id": F.col("_trace"),
        "span_id": F.col("_span"),
        "parent_span_id": F.when(_zero(span["parent_id"]) != 0, S.hex16(span["parent_id"])),
        "span_kind": F.coalesce(meta["span.kind"], F.lit("unspecified")),
        "span_status": F.when(_zero(span["error"]) == 0, "unset").otherwise("error"),
        "duration_ns": _zero(span["duration"]),
        "environment": meta["env"],
        "service_name": F.nullif(_text(span["service"]), F.lit("")),
        "raw": F.to_json(_raw(span), {"ignoreNullFields": "false"}),
    }


def _span_fields() -> list[Column]:
    span, meta = F.col("span"), F.col("_meta")
    nonempty = lambda c: V.of(F.nullif(_text(c), F.lit("")))
    failed = _zero(span["error"]) != 0
    finite = F.map_filter("_metrics", lambda _, v: S.is_finite(v))
    return [
        V.field_map(
            ("resource.name", nonempty(span["resource"])),
            ("resource.service.version", V.of(meta["version"])),
            ("span.status_message", V.of(F.when(failed, meta["error.msg"]))),
        ),
        # Metrics replace tags of the same name, and both the span type.
        V.prefix_keys(F.transform_values(finite, lambda _, v: V.of(v)), "attribute."),
        V.prefix_keys(F.transform_values(meta, lambda _, v: V.of(v)), "attribute."),
        V.field_map(("attribute.datadog.type", nonempty(span["type"]))),
    ]


def _records(rows: DataFrame, columns: dict[str, Column], *fields: Column) -> DataFrame:
    return conform(
        rows.select(
            "project_id",
            "received_at_ms",
            F.lit(SOURCE).alias("source"),
            *[column.alias(name) for name, column in columns.items()],
            F.to_variant_object(V.merge(*fields)).alias("fields"),
        )
    )


def flatten_ddtrace(payloads: DataFrame) -> DataFrame:
    """Valid spans as trace records."""
    return _records(_keyed(payloads), _span_columns(), *_span_fields())


def ddtrace_errors(payloads: DataFrame) -> DataFrame:
    """Failed spans as error records linked to their span."""
    span, meta = F.col("span"), F.col("_meta")
    kind = F.coalesce(meta["error.type"], F.lit("Error"))
    value = F.coalesce(meta["error.msg"], _text(span["resource"]))
    title = S.error_title(kind, value)
    error_id = F.concat(F.col("_id"), F.lit("-error"))
    raw = F.struct(F.col("_id").alias("source_record_id"), _raw(span).alias("span"))
    columns = {
        **_span_columns(),
        "id": error_id,
        "source_id": error_id,
        "signal": F.lit("error"),
        "level": F.lit("error"),
        "message": value,
        "title": title,
        "error_type": kind,
        "error_value": value,
        "issue_title": title,
        "issue_fingerprint": F.concat(F.lit("ddtrace:"), kind),
        "source_record_id": F.col("_id"),
        "raw": F.to_json(raw, {"ignoreNullFields": "false"}),
    }
    stack = V.field_map(("error.stacktrace", V.of(meta["error.stack"])))
    failed = _keyed(payloads).filter(_zero(span["error"]) != 0)
    return _records(failed, columns, stack, *_span_fields())


def ddtrace_records(payloads: DataFrame) -> DataFrame:
    """Trace records and the errors of failed spans."""
    return flatten_ddtrace(payloads).unionByName(ddtrace_errors(payloads))
