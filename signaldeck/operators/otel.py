"""OpenTelemetry batches -> records: spans, logs, metric points and derived errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.functions import scalars as S
from signaldeck.functions import variants as V
from signaldeck.functions.stage import once, staged
from signaldeck.schema import conform
from signaldeck.sources.otel import ATTRIBUTES, items, scopes

SOURCE = "otlp"
# Reject reasons.
INVALID_SPAN = "otlp.invalid_span"
INVALID_LOG = "otlp.invalid_log"
INVALID_POINT = "otlp.invalid_metric_point"

KEEP_NULLS = {"ignoreNullFields": "false"}

# Pieces of a value's compact wire JSON with sorted keys.  Each is rewritten by itself, so no
# depth is set: an array or list begins, ends or is empty; a scalar; an entry without a value;
# an unset value; text; anything else.
_PIECES = (
    r'\{"(?:array|kvlist)_value":\{(?:"values":(?:null|\[\]))?\}\}|\{"(?:array|kvlist)_value":\{"values":\['
    r'|\{"(?:string|bool|int|double|bytes)_value":(?:"[^"]*"|[^"{}\[\],]*)\}|\{"key":"[^"]*"\}|\{\}|\]\}\}|"[^"]*"|[^"{\]]+|[{\]]'
)
# Members that are null; a quote before a letter begins a name.
_NULL_MEMBERS = r'(?<=\{)(?:"[a-z]+_value":null(?:,|(?=\})))+|,"[a-z]+_value":null(?=[,}])'


# --- values -----------------------------------------------------------------

def any_value(value: Column) -> Column:
    """One-of value as VARIANT; an unset value is JSON null, a text that is no number stays text."""
    whole, double = value["int_value"].try_cast("bigint"), value["double_value"].try_cast("double")
    scalars = [
        value["string_value"].cast("variant"),
        value["bool_value"].cast("variant"),
        whole.cast("variant"),
        S.finite_number(double),
        F.coalesce(value["int_value"], value["double_value"]).cast("string").cast("variant"),
        S.hex_bytes(value["bytes_value"]).cast("variant"),
    ]
    wire = F.coalesce(
        F.concat(F.lit('{"array_value":'), value["array_value"], F.lit("}")),
        F.concat(F.lit('{"kvlist_value":'), value["kvlist_value"], F.lit("}")),
    )
    return F.coalesce(*scalars, _decoded(wire), V.json_null())


def _decoded(wire: Column) -> Column:
    """Wire JSON of a one-of value of any depth as VARIANT; JSON of another form as it is."""
    compact = F.regexp_replace(F.to_json(F.try_parse_json(wire)), F.lit(_NULL_MEMBERS), F.lit(""))
    # Without escaped quotes a text ends at the next quote; JSON holds no such characters itself.
    compact = F.replace(F.replace(compact, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    text = F.array_join(F.transform(F.regexp_extract_all(compact, F.lit(_PIECES), F.lit(0)), _piece), "")
    text = F.replace(F.replace(text, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(wire))


def _piece(piece: Column) -> Column:
    kind = F.regexp_extract(piece, r'^\{"([a-z]+)_value":', 1)
    inner = F.regexp_extract(piece, r'(?s)^\{"[a-z]+_value":(.*)\}$', 1)
    bare = F.replace(inner, F.lit('"'), F.lit(""))
    double = bare.try_cast("double")
    shown = double.cast("string")
    decoded = (
        F.when(kind.isin("array", "kvlist"), F.when(piece.endswith("}"), "[]").otherwise("["))
        .when(kind == "string", F.concat(F.lit('"'), bare, F.lit('"')))
        .when(kind == "bool", F.when(inner.isin("true", "false"), inner))
        .when(kind == "int", F.coalesce(bare.try_cast("bigint").cast("string"), F.concat(F.lit('"'), bare, F.lit('"'))))
        # With an exponent it is read as a DOUBLE again.
        .when(kind == "double", F.when(~S.is_finite(double), F.concat(F.lit('"'), shown, F.lit('"')))
              .otherwise(F.when(shown.contains("E"), shown).otherwise(F.concat(shown, F.lit("E0")))))
        .when(kind == "bytes", F.concat(F.lit('"'), S.hex_bytes(F.try_to_binary(bare, F.lit("base64"))), F.lit('"')))
        .when(piece == "]}}", "]")
        .when(piece.startswith('{"key":'), F.concat(F.regexp_replace(piece, r"\}$", ""), F.lit(',"value":null}')))
        .when(piece != "{}", piece)
    )
    return F.coalesce(decoded, F.lit("null"))


def pairs(attributes: Column, prefix: str = "") -> Column:
    """Attributes as an array of (key, VARIANT value), order and duplicates kept."""
    named = lambda key: F.concat(F.lit(prefix), key) if prefix else key
    return F.transform(
        attributes,
        lambda kv: F.struct(named(kv["key"]).alias("key"), any_value(kv["value"]).alias("value")),
    )


def attributes_of(attributes: Column, prefix: str = "") -> Column:
    """Attributes as a map, ``prefix`` before each key; empty keys dropped, the last value of a key wins."""
    named = F.filter(
        F.coalesce(attributes, F.array().cast(ATTRIBUTES)), lambda kv: F.coalesce(kv["key"], F.lit("")) != ""
    )
    return V.map_of_pairs(pairs(named, prefix))


def _text(column: Column) -> Column:
    """NULL for missing and for empty text."""
    return F.nullif(column, F.lit(""))


def resource_raw() -> Column:
    r = F.col("resource")
    return F.struct(
        pairs(r["attributes"]).alias("attributes"),
        r["dropped_attributes_count"].alias("dropped_attributes_count"),
        r["entity_refs"].alias("entity_refs"),
        F.coalesce("resource_schema_url", F.lit("")).alias("schema_url"),
    )


def scope_raw() -> Column:
    s = F.col("scope")
    return F.struct(
        s["name"].alias("name"),
        s["version"].alias("version"),
        pairs(s["attributes"]).alias("attributes"),
        s["dropped_attributes_count"].alias("dropped_attributes_count"),
        F.coalesce("scope_schema_url", F.lit("")).alias("schema_url"),
    )


def with_context(scope_rows: DataFrame) -> DataFrame:
    """Add, once per resource and scope, the fields and JSON shared by all their items.

    ``_context`` holds resource and scope fields, ``_service`` the service name,
    ``_resource`` and ``_scope`` the raw forms.
    """
    resource = attributes_of(F.col("resource.attributes"), "resource.")
    scope = attributes_of(F.col("scope.attributes"), "scope.attribute.")
    fixed = V.field_map(
        ("resource.schema_url", V.of(_text(F.col("resource_schema_url")))),
        ("scope.name", V.of(_text(F.col("scope.name")))),
        ("scope.version", V.of(_text(F.col("scope.version")))),
        ("scope.schema_url", V.of(_text(F.col("scope_schema_url")))),
    )
    service = lambda every: V.as_string(every["resource.service.name"])
    own = lambda every, service: F.when(
        service.isNotNull(), F.map_filter(every, lambda name, _: name != "resource.service.name")
    ).otherwise(every)
    shared = once(
        V.merge(fixed, resource, scope),
        lambda every: once(
            service(every), lambda name: F.struct(name.alias("service"), own(every, name).alias("context"))
        ),
    )
    # The raw forms are left to the planner, which drops them where no raw text is asked for.
    rows = staged(scope_rows, _shared=shared).withColumns({
        "_service": F.col("_shared.service"), "_context": F.col("_shared.context"),
        "_resource": resource_raw(), "_scope": scope_raw(),
    })
    return rows.drop("_shared", "resource", "scope", "resource_schema_url", "scope_schema_url")


def _record(rows: DataFrame, columns: dict[str, Column], *rest: Column) -> DataFrame:
    """Record rows out of typed columns and maps of further fields (earlier maps win)."""
    return conform(
        rows.select(
            "project_id",
            "received_at_ms",
            F.lit(SOURCE).alias("source"),
            F.col("_service").alias("service_name"),
            *[column.alias(name) for name, column in columns.items()],
            F.to_variant_object(V.merge(*rest, F.col("_context"))).alias("fields"),
        )
    )


# --- validation -------------------------------------------------------------

def valid_id(value: Column, length: int) -> Column:
    return F.coalesce(
        (F.octet_length(value) == length) & (F.hex(value) != "0" * (2 * length)), F.lit(False)
    )


def _absent(value: Column) -> Column:
    return value.isNull() | (F.octet_length(value) == 0)


def valid_span(span: Column) -> Column:
    """16 / 8 byte non-zero ids, a name, a start not negative and an end not before it."""
    return (
        valid_id(span["trace_id"], 16)
        & valid_id(span["span_id"], 8)
        & (_absent(span["parent_span_id"]) | valid_id(span["parent_span_id"], 8))
        & (F.coalesce(span["name"], F.lit("")) != "")
        & (_zero(span["start_time_unix_nano"]) >= 0)
        & (_zero(span["end_time_unix_nano"]) >= _zero(span["start_time_unix_nano"]))
    )


def _zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0))


def valid_log(log: Column) -> Column:
    """Ids valid where given, no span id without trace id, severity 0..24."""
    return (
        (_absent(log["trace_id"]) | valid_id(log["trace_id"], 16))
        & (_absent(log["span_id"]) | (valid_id(log["span_id"], 8) & ~_absent(log["trace_id"])))
        & _zero(log["severity_number"]).between(0, 24)
    )


def _empty_if_null(array: Column, element: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{element}>"))


def _total(counts: Column, start: Column | int = 0) -> Column:
    """Sum of counts; NULL on overflow."""
    begin = start if isinstance(start, Column) else F.lit(start)
    return F.aggregate(counts, begin.cast("bigint"), lambda total, n: F.try_add(total, n))


def _rising(values: Column) -> Column:
    """Strictly increasing."""
    rest = F.greatest(F.size(values) - 1, F.lit(0))
    steps = F.zip_with(
        F.slice(values, F.lit(1), rest), F.slice(values, F.lit(2), rest), lambda a, b: a < b
    )
    return (F.size(values) < 2) | F.forall(steps, lambda ok: ok)


def valid_temporality(code: Column) -> Column:
    return F.coalesce(code.isin(1, 2), F.lit(False))


def valid_histogram(point: Column, temporality: Column) -> Column:
    """Counts match bounds and total; bounds finite and strictly increasing."""
    counts = _empty_if_null(point["bucket_counts"], "bigint")
    bounds = _empty_if_null(point["explicit_bounds"], "double")
    shaped = (
        (F.size(counts) == F.size(bounds) + 1)
        & (_total(counts) == _zero(point["count"]))
        & F.forall(bounds, S.is_finite)
        & _rising(bounds)
    )
    empty = (F.size(counts) == 0) & (F.size(bounds) == 0)
    return valid_temporality(temporality) & F.coalesce(empty | shaped, F.lit(False))


def valid_exponential(point: Column, temporality: Column) -> Column:
    """Positive, negative and zero counts add up to the total."""
    positive = _empty_if_null(point["positive"]["bucket_counts"], "bigint")
    negative = _empty_if_null(point["negative"]["bucket_counts"], "bigint")
    total = _total(negative, _total(positive, _zero(point["zero_count"])))
    return valid_temporality(temporality) & F.coalesce(total == _zero(point["count"]), F.lit(False))


def valid_summary(point: Column) -> Column:
    """Quantiles in [0, 1] and strictly increasing, values finite."""
    pairs_ = F.coalesce(
        point["quantile_values"], F.array().cast("array<struct<quantile: double, value: double>>")
    )
    inside = F.forall(
        pairs_,
        lambda q: S.is_finite(q["quantile"]) & q["quantile"].between(0.0, 1.0) & S.is_finite(q["value"]),
    )
    return F.coalesce(inside & _rising(F.transform(pairs_, lambda q: q["quantile"])), F.lit(False))


def valid_point(point: Column) -> Column:
    """Rules common to all points: name, time, start not after time, finite scalar."""
    scalar = point["type"].isin("gauge", "sum")
    return (
        (F.coalesce(point["name"], F.lit("")) != "")
        & (_zero(point["time"]) != 0)
        & (_zero(point["start"]) <= _zero(point["time"]))
        & (~scalar | S.is_finite(point["value"]))
        & F.coalesce(point["well_formed"], F.lit(False))
    )


# --- traces -----------------------------------------------------------------

def spans_of(batches: DataFrame) -> DataFrame:
    """One row per span with a ``valid`` flag."""
    return _checked_spans(scopes(batches, "traces"))


def _checked_spans(scope_rows: DataFrame) -> DataFrame:
    rows = items(scope_rows, "span")
    return rows.withColumn("valid", F.coalesce(valid_span(F.col("span")), F.lit(False)))


def _span_keys(scope_rows: DataFrame) -> DataFrame:
    span = F.col("span")
    rows = _checked_spans(with_context(scope_rows))
    keyed = rows.filter("valid").withColumns(
        {"_trace": S.hex_bytes(span["trace_id"]), "_span": S.hex_bytes(span["span_id"])}
    )
    return keyed.withColumn("_id", F.concat_ws("-", "_trace", "_span"))


def event_raw(event: Column) -> Column:
    return F.struct(
        event["time_unix_nano"].alias("time_unix_nano"),
        event["name"].alias("name"),
        pairs(event["attributes"]).alias("attributes"),
        event["dropped_attributes_count"].alias("dropped_attributes_count"),
    )


def span_raw(span: Column) -> Column:
    status = span["status"]
    return F.struct(
        S.hex_bytes(span["trace_id"]).alias("trace_id"),
        S.hex_bytes(span["span_id"]).alias("span_id"),
        span["trace_state"].alias("trace_state"),
        S.hex_bytes(span["parent_span_id"]).alias("parent_span_id"),
        span["flags"].alias("flags"),
        span["name"].alias("name"),
        span["kind"].alias("kind"),
        S.span_kind(span["kind"]).alias("kind_name"),
        span["start_time_unix_nano"].alias("start_time_unix_nano"),
        span["end_time_unix_nano"].alias("end_time_unix_nano"),
        pairs(span["attributes"]).alias("attributes"),
        span["dropped_attributes_count"].alias("dropped_attributes_count"),
        F.transform(span["events"], event_raw).alias("events"),
        span["dropped_events_count"].alias("dropped_events_count"),
        F.transform(
            span["links"],
            lambda link: F.struct(
                S.hex_bytes(link["trace_id"]).alias("trace_id"),
                S.hex_bytes(link["span_id"]).alias("span_id"),
                link["trace_state"].alias("trace_state"),
                pairs(link["attributes"]).alias("attributes"),
                link["dropped_attributes_count"].alias("dropped_attributes_count"),
                link["flags"].alias("flags"),
            ),
        ).alias("links"),
        span["dropped_links_count"].alias("dropped_links_count"),
        F.when(
            status.isNotNull(),
            F.struct(
                status["code"].alias("code"),
                S.status_code(status["code"]).alias("code_name"),
                status["message"].alias("message"),
            ),
        ).alias("status"),
    )


def flatten_spans(batches: DataFrame) -> DataFrame:
    """Valid spans as trace records."""
    span = F.col("span")
    raw = F.struct(
        F.col("_resource").alias("resource"), F.col("_scope").alias("scope"), span_raw(span).alias("span")
    )
    return _record(
        _span_keys(scopes(batches, "traces")),
        {
            "id": F.col("_id"),
            "source_id": F.col("_id"),
            "signal": F.lit("trace"),
            "ts_nano": _zero(span["start_time_unix_nano"]),
            "name": span["name"],
            "message": span["name"],
            "trace_id": F.col("_trace"),
            "span_id": F.col("_span"),
            "parent_span_id": _text(S.hex_bytes(span["parent_span_id"])),
            "span_kind": S.span_kind(span["kind"]),
            "span_status": S.status_code(span["status"]["code"]),
            "duration_ns": _zero(span["end_time_unix_nano"]) - _zero(span["start_time_unix_nano"]),
            "raw": F.to_json(raw, KEEP_NULLS),
        },
        V.field_map(("span.status_message", V.of(_text(span["status"]["message"])))),
        attributes_of(span["attributes"], "attribute."),
    )


def _with_exception(rows: DataFrame, name: Column) -> DataFrame:
    """Keep rows that describe an exception; add its type, value and other parts.

    Needs ``_own`` (the attribute map); ``name`` is the event name."""
    text = lambda key: V.as_string(F.col("_own")[key])
    found = rows.filter(
        F.coalesce(name == "exception", F.lit(False))
        | F.array_contains(F.map_keys("_own"), "exception.type")
    )
    return found.withColumns(
        {
            "_type": F.coalesce(text("exception.type"), F.lit("Exception")),
            "_value": F.coalesce(text("exception.message"), F.lit("")),
            "_stack": text("exception.stacktrace"),
            "_handled": ~V.as_bool(F.col("_own")["exception.escaped"]),
        }
    )


def _error_columns() -> dict[str, Column]:
    title = S.error_title(F.col("_type"), F.col("_value"))
    return {
        "signal": F.lit("error"),
        "level": F.lit("error"),
        "message": F.col("_value"),
        "title": title,
        "error_type": F.col("_type"),
        "error_value": F.col("_value"),
        "error_handled": F.col("_handled"),
        "issue_title": title,
        "issue_fingerprint": F.concat(F.lit("otlp:"), F.col("_type")),
        "source_record_id": F.col("_id"),
    }


def _error_fields() -> Column:
    exception = F.struct(
        F.col("_type").alias("type"),
        F.col("_value").alias("message"),
        F.col("_stack").alias("stacktrace"),
        F.col("_handled").alias("handled"),
    )
    return V.field_map(
        ("error.exceptions", F.parse_json(F.to_json(F.array(exception)))),
        ("error.stacktrace", F.col("_own")["exception.stacktrace"]),
    )


def span_exceptions(batches: DataFrame) -> DataFrame:
    """Exception events of valid spans as error records linked to their span."""
    span = F.col("span")
    # Scopes without events need no context.
    scope_rows = scopes(batches, "traces").filter(F.exists("_items", lambda item: F.size(item["events"]) > 0))
    rows = _span_keys(scope_rows).select(
        "*", F.posexplode("span.events").alias("_index", "event")
    )
    rows = staged(rows, _own=attributes_of(F.col("event.attributes")))
    rows = _with_exception(rows, F.col("event.name"))
    event_time = _zero(F.col("event.time_unix_nano"))
    error_id = F.concat_ws(
        "-", "_id", F.lit("exception"), event_time.cast("string"), F.col("_index").cast("string")
    )
    raw = F.struct(
        F.col("_resource").alias("resource"),
        F.col("_scope").alias("scope"),
        F.col("_id").alias("source_record_id"),
        event_raw(F.col("event")).alias("event"),
    )
    return _record(
        rows,
        {
            **_error_columns(),
            "id": error_id,
            "source_id": error_id,
            "ts_nano": F.when(event_time == 0, _zero(span["start_time_unix_nano"])).otherwise(event_time),
            "trace_id": F.col("_trace"),
            "span_id": F.col("_span"),
            "raw": F.to_json(raw, KEEP_NULLS),
        },
        _error_fields(),
        V.prefix_keys(F.col("_own"), "attribute."),
        attributes_of(span["attributes"], "attribute."),
    )


def otel_traces(batches: DataFrame) -> DataFrame:
    """Trace records and the errors derived from their exception events."""
    return flatten_spans(batches).unionByName(span_exceptions(batches))


# --- logs -------------------------------------------------------------------

def logs_of(batches: DataFrame) -> DataFrame:
    """One row per log record with a ``valid`` flag."""
    return _checked_logs(scopes(batches, "logs"))


def _checked_logs(scope_rows: DataFrame) -> DataFrame:
    rows = items(scope_rows, "log")
    return rows.withColumn("valid", F.coalesce(valid_log(F.col("log")), F.lit(False)))


def log_raw(log: Column) -> Column:
    return F.struct(
        log["time_unix_nano"].alias("time_unix_nano"),
        log["observed_time_unix_nano"].alias("observed_time_unix_nano"),
        log["severity_number"].alias("severity_number"),
        log["severity_text"].alias("severity_text"),
        F.when(log["body"].isNotNull(), any_value(log["body"])).alias("body"),
        pairs(log["attributes"]).alias("attributes"),
        log["dropped_attributes_count"].alias("dropped_attributes_count"),
        log["flags"].alias("flags"),
        S.hex_bytes(log["trace_id"]).alias("trace_id"),
        S.hex_bytes(log["span_id"]).alias("span_id"),
        log["event_name"].alias("event_name"),
    )


def _log_keys(batches: DataFrame) -> DataFrame:
    log = F.col("log")
    rows = _checked_logs(with_context(scopes(batches, "logs")))
    raw = F.struct(
        F.col("_resource").alias("resource"), F.col("_scope").alias("scope"), log_raw(log).alias("log_record")
    )
    keyed = staged(
        rows.filter("valid"), _raw=F.to_json(raw, KEEP_NULLS), _own=attributes_of(log["attributes"])
    )
    return keyed.withColumns(
        {
            "_id": ids.uuid5(ids.OTEL_NAMESPACE, F.col("_raw")),
            "_time": F.coalesce(
                F.nullif(log["time_unix_nano"], F.lit(0)),
                F.nullif(log["observed_time_unix_nano"], F.lit(0)),
                F.col("received_at_ms") * 1_000_000,
            ),
        }
    )


def _log_ids() -> dict[str, Column]:
    return {
        "trace_id": _text(S.hex_bytes(F.col("log.trace_id"))),
        "span_id": _text(S.hex_bytes(F.col("log.span_id"))),
        "ts_nano": F.col("_time"),
        "raw": F.col("_raw"),
    }


def flatten_logs(batches: DataFrame) -> DataFrame:
    """Valid log records; the body is the message (non-text bodies as JSON)."""
    log = F.col("log")
    body = F.coalesce(any_value(log["body"]), V.json_null())
    message = F.when(log["body"].isNull(), F.lit("")).otherwise(
        F.coalesce(V.as_string(body), F.to_json(body))
    )
    return _record(
        _log_keys(batches),
        {
            **_log_ids(),
            "id": F.col("_id"),
            "source_id": F.col("_id"),
            "signal": F.lit("log"),
            "message": message,
            "level": S.severity(_zero(log["severity_number"]), log["severity_text"]),
        },
        V.field_map(
            ("severity_text", V.of(_text(log["severity_text"]))),
            ("event.name", V.of(_text(log["event_name"]))),
        ),
        V.prefix_keys(F.col("_own"), "attribute."),
    )


def log_exceptions(batches: DataFrame) -> DataFrame:
    """Logs that describe an exception as error records linked to the log."""
    rows = _with_exception(_log_keys(batches), F.col("log.event_name"))
    error_id = F.concat(F.col("_id"), F.lit("-exception"))
    return _record(
        rows,
        {**_error_columns(), **_log_ids(), "id": error_id, "source_id": error_id},
        _error_fields(),
        V.prefix_keys(F.col("_own"), "attribute."),
    )


def otel_logs(batches: DataFrame) -> DataFrame:
    """Log records and the errors derived from them."""
    return flatten_logs(batches).unionByName(log_exceptions(batches))


# --- metrics ----------------------------------------------------------------

def _number(point: Column) -> Column:
    return F.coalesce(point["as_double"], point["as_int"].cast("double"))


def _exemplars(point: Column) -> Column:
    return F.transform(
        point["exemplars"],
        lambda e: F.struct(
            pairs(e["filtered_attributes"]).alias("filtered_attributes"),
            e["time_unix_nano"].alias("time_unix_nano"),
            S.hex_bytes(e["span_id"]).alias("span_id"),
            S.hex_bytes(e["trace_id"]).alias("trace_id"),
            F.coalesce(S.finite_number(e["as_double"]), e["as_int"].cast("variant")).alias("value"),
        ),
    )


def _point_raw(point: Column, kind: str) -> Column:
    number = lambda name: S.finite_number(point[name]).alias(name)
    plain = lambda *names: [point[name].alias(name) for name in names]
    common = [
        pairs(point["attributes"]).alias("attributes"),
        *plain("start_time_unix_nano", "time_unix_nano", "flags"),
    ]
    if kind != "summary":
        common.append(_exemplars(point).alias("exemplars"))
    if kind in ("gauge", "sum"):
        value = F.coalesce(S.finite_number(point["as_double"]), point["as_int"].cast("variant"))
        special = [value.alias("value")]
    elif kind == "histogram":
        bounds = F.transform(point["explicit_bounds"], S.finite_number).alias("explicit_bounds")
        special = [*plain("count"), number("sum"), *plain("bucket_counts"), bounds, number("min"), number("max")]
    elif kind == "exponential_histogram":
        special = [
            *plain("count"), number("sum"), *plain("scale", "zero_count", "positive", "negative"),
            number("min"), number("max"), number("zero_threshold"),
        ]
    else:
        quantiles = F.transform(
            point["quantile_values"],
            lambda q: F.struct(
                S.finite_number(q["quantile"]).alias("quantile"),
                S.finite_number(q["value"]).alias("value"),
            ),
        )
        special = [*plain("count"), number("sum"), quantiles.alias("quantile_values")]
    return F.to_json(F.struct(*common, *special), KEEP_NULLS)


def _points(metric: Column, kind: str) -> Column:
    """Data points of one kind in the common point shape; NULL if the metric has none."""
    data = metric[kind]
    temporality = F.lit(None).cast("int")
    if kind not in ("gauge", "summary"):
        temporality = F.coalesce(data["aggregation_temporality"], F.lit(0))
    monotonic = F.coalesce(data["is_monotonic"], F.lit(False)) if kind == "sum" else F.lit(None).cast("boolean")

    def well_formed(point: Column) -> Column:
        return {
            "gauge": lambda: F.lit(True),
            "sum": lambda: valid_temporality(temporality),
            "histogram": lambda: valid_histogram(point, temporality),
            "exponential_histogram": lambda: valid_exponential(point, temporality),
            "summary": lambda: valid_summary(point),
        }[kind]()

    return F.transform(
        data["data_points"],
        lambda point: F.struct(
            F.lit(kind).alias("type"),
            temporality.alias("temporality"),
            monotonic.alias("monotonic"),
            _zero(point["start_time_unix_nano"]).alias("start"),
            _zero(point["time_unix_nano"]).alias("time"),
            (_number(point) if kind in ("gauge", "sum") else F.lit(None).cast("double")).alias("value"),
            well_formed(point).alias("well_formed"),
            point["attributes"].alias("attributes"),
            _point_raw(point, kind).alias("raw"),
        ),
    )


POINT_KINDS = ("gauge", "sum", "histogram", "exponential_histogram", "summary")


def points_of(batches: DataFrame) -> DataFrame:
    """One row per data point of any kind (one pass) with a ``valid`` flag."""
    return _checked_points(scopes(batches, "metrics"))


def _checked_points(scope_rows: DataFrame) -> DataFrame:
    metric = F.col("metric")
    chosen = F.coalesce(*[_points(metric, kind) for kind in POINT_KINDS])
    rows = staged(items(scope_rows, "metric"), _points=chosen, metric_name=metric["name"])
    rows = rows.withColumn("point", F.explode("_points")).drop("_points")
    point = F.col("point")
    named = F.struct(F.col("metric_name").alias("name"), *[point[c].alias(c) for c in (
        "type", "time", "start", "value", "well_formed")])
    return rows.withColumn("valid", F.coalesce(valid_point(named), F.lit(False)))


def stream_id() -> Column:
    """Identity of a metric stream over name, type, unit, resource, scope, attributes.

    For rows of points with the context of :func:`with_context`."""
    metric, point = F.col("metric"), F.col("point")
    identity = F.struct(
        metric["name"].alias("name"),
        point["type"].alias("type"),
        F.coalesce(metric["unit"], F.lit("")).alias("unit"),
        point["temporality"].alias("temporality"),
        point["monotonic"].alias("monotonic"),
        F.col("_resource").alias("resource"),
        F.col("_scope").alias("scope"),
        pairs(point["attributes"]).alias("attributes"),
    )
    return ids.uuid5(ids.OTEL_NAMESPACE, F.to_json(identity, KEEP_NULLS))


def flatten_metrics(batches: DataFrame) -> DataFrame:
    """Valid data points as metric records.

    Gauges and sums carry a scalar value; the other kinds keep their whole point in
    ``raw`` only.
    """
    metric, point = F.col("metric"), F.col("point")
    temporality = F.when(point["temporality"].isNotNull(), S.temporality_name(point["temporality"]))
    rows = _checked_points(with_context(scopes(batches, "metrics"))).filter("valid")
    rows = rows.withColumn("_stream", stream_id())
    point_id = F.concat_ws(
        "-", "_stream", point["type"], point["start"].cast("string"), point["time"].cast("string")
    )
    described = F.struct(
        metric["name"].alias("name"),
        metric["description"].alias("description"),
        metric["unit"].alias("unit"),
        pairs(metric["metadata"]).alias("metadata"),
        point["type"].alias("type"),
        temporality.alias("temporality"),
        point["monotonic"].alias("monotonic"),
    )
    raw = F.struct(
        F.col("_resource").alias("resource"),
        F.col("_scope").alias("scope"),
        described.alias("metric"),
        F.parse_json(point["raw"]).alias("data_point"),
    )
    return _record(
        rows,
        {
            "id": point_id,
            "source_id": point_id,
            "signal": F.lit("metric"),
            "ts_nano": point["time"],
            "name": metric["name"],
            "type": point["type"],
            "unit": _text(metric["unit"]),
            "temporality": temporality,
            "monotonic": point["monotonic"],
            "value": point["value"],
            "start_nano": F.nullif(point["start"], F.lit(0)),
            "stream_id": F.col("_stream"),
            "raw": F.to_json(raw, KEEP_NULLS),
        },
        V.field_map(("description", V.of(_text(metric["description"])))),
        attributes_of(point["attributes"], "attribute."),
    )


# --- rejects ----------------------------------------------------------------

def rejects(batches: DataFrame, kind: str) -> DataFrame:
    """One row (project_id, reason) per invalid span, log record or data point."""
    rows, reason = {
        "traces": (spans_of, INVALID_SPAN),
        "logs": (logs_of, INVALID_LOG),
        "metrics": (points_of, INVALID_POINT),
    }[kind]
    return rows(batches).filter(~F.col("valid")).select("project_id", F.lit(reason).alias("reason"))


def reject_counts(*reject_rows: DataFrame) -> DataFrame:
    """Rejects per reason over any sources."""
    union = reject_rows[0].select("reason")
    for rows in reject_rows[1:]:
        union = union.unionByName(rows.select("reason"))
    return union.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))

