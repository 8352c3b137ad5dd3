"""OpenTelemetry requests read from JSON files."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from signaldeck.functions import variants as V
from signaldeck.operators import otel as O
from signaldeck.sources.otel import otel_ddl, read_otel

TRACE, SPAN = bytes(range(16)), bytes(range(1, 9))


def b64(value):
    return base64.b64encode(value).decode()


def kv(key, value, kind="string_value"):
    return {"key": key, "value": {kind: value}}


def read(spark, folder, kind, items, resource=None, scope=None):
    top, scoped, leaf = {"traces": ("resource_spans", "scope_spans", "spans"), "logs": ("resource_logs", "scope_logs", "log_records"),
                         "metrics": ("resource_metrics", "scope_metrics", "metrics")}[kind]
    request = {top: [{"resource": resource or {"attributes": [kv("service.name", "api")]}, "schema_url": "rs",
                      scoped: [{"scope": scope or {"name": "lib", "version": "1", "attributes": [kv("k", "v")]}, "schema_url": "", leaf: items}]}]}
    (folder / "r.json").write_text(json.dumps(request))
    return read_otel(spark, str(folder), kind, 1, 9)


def fields(row):
    return json.loads(row.f)


def with_json(df):
    return df.withColumn("f", F.to_json("fields")).collect()


def test_span_and_its_exception(spark, tmp_path):
    span = {"trace_id": b64(TRACE), "span_id": b64(SPAN), "name": "resize image", "kind": 2, "start_time_unix_nano": 100,
            "end_time_unix_nano": 350, "status": {"code": 2, "message": "no memory"},
            "attributes": [kv("a", "span"), kv("b", 2, "int_value"), kv("b", 3, "int_value"), kv("", "x")],
            "events": [{"name": "other", "time_unix_nano": 5},
                       {"name": "exception", "time_unix_nano": 0, "attributes": [
                           kv("exception.type", "ImageTooLarge"), kv("exception.message", "90 MP"), kv("a", "event"),
                           kv("exception.escaped", True, "bool_value"), kv("exception.stacktrace", "at x")]}]}
    rows = {r.signal: r for r in with_json(O.otel_traces(read(spark, tmp_path, "traces", [span])))}
    trace, error = rows["trace"], rows["error"]
    assert trace.id == f"{TRACE.hex()}-{SPAN.hex()}" and trace.duration_ns == 250 and trace.service_name == "api"
    assert (trace.span_kind, trace.span_status, trace.message, trace.parent_span_id) == ("server", "error", "resize image", None)
    assert fields(trace) == {"attribute.a": "span", "attribute.b": 3, "resource.schema_url": "rs", "scope.name": "lib",
                             "scope.version": "1", "scope.attribute.k": "v", "span.status_message": "no memory"}
    raw = json.loads(trace.raw)
    assert [a["value"] for a in raw["span"]["attributes"] if a["key"] == "b"] == [2, 3]  # raw keeps duplicates
    assert error.id == f"{trace.id}-exception-0-1" and error.source_record_id == trace.id and error.ts_nano == 100
    assert (error.title, error.error_handled, error.issue_fingerprint) == ("ImageTooLarge: 90 MP", False, "otlp:ImageTooLarge")
    got = fields(error)
    assert got["attribute.a"] == "event" and got["error.stacktrace"] == "at x"
    assert got["error.exceptions"] == [{"type": "ImageTooLarge", "message": "90 MP", "stacktrace": "at x", "handled": False}]


def test_log_exception_and_body_forms(spark, tmp_path):
    logs = [
        {"event_name": "exception", "body": {"string_value": "cache is cold"}, "severity_number": 17, "observed_time_unix_nano": 7,
         "attributes": [kv("exception.message", "3 keys missing")]},
        {"body": {"kvlist_value": {"values": [kv("n", 1, "int_value")]}}, "severity_text": "WARNING", "time_unix_nano": 8},
        {"trace_id": b64(TRACE), "span_id": b64(SPAN)},
        {"span_id": b64(SPAN)}, {"severity_number": 25}, {"trace_id": b64(bytes(16))},
    ]
    batches = read(spark, tmp_path, "logs", logs)
    rows = with_json(O.otel_logs(batches))
    error = next(r for r in rows if r.signal == "error")
    by_message = {r.message: r for r in rows if r.signal == "log"}
    assert set(by_message) == {"cache is cold", '[{"key":"n","value":1}]', ""}
    log = by_message["cache is cold"]
    assert (error.title, error.source_record_id, error.id) == ("Exception: 3 keys missing", log.id, f"{log.id}-exception")
    assert (log.level, log.ts_nano, fields(log)["event.name"]) == ("error", 7, "exception")
    assert by_message[""].ts_nano == 9_000_000 and by_message[""].span_id == SPAN.hex()
    assert by_message['[{"key":"n","value":1}]'].level == "warn"
    assert O.reject_counts(O.rejects(batches, "logs")).collect() == [("otlp.invalid_log", 3)]


POINT = {"time_unix_nano": 20, "start_time_unix_nano": 10}


def test_five_point_kinds_and_a_reject(spark, tmp_path):
    metrics = [
        {"name": "g", "unit": "ms", "description": "d", "gauge": {"data_points": [{**POINT, "as_double": 1.5}, {**POINT}]}},
        {"name": "s", "sum": {"aggregation_temporality": 2, "is_monotonic": True, "data_points": [
            {**POINT, "as_int": 4, "attributes": [kv("x", "1")]}, {"time_unix_nano": 21, "as_int": 5, "attributes": [kv("x", "1")]}]}},
        {"name": "h", "histogram": {"aggregation_temporality": 1, "data_points": [
            {**POINT, "count": 3, "bucket_counts": [1, 2], "explicit_bounds": [0.5], "sum": 4.0}]}},
        {"name": "e", "exponential_histogram": {"aggregation_temporality": 1, "data_points": [
            {**POINT, "count": 3, "zero_count": 1, "scale": 2, "positive": {"offset": 0, "bucket_counts": [2]}}]}},
        {"name": "q", "summary": {"data_points": [{**POINT, "count": 1, "sum": 2.0, "quantile_values": [{"quantile": 0.5, "value": 2.0}]}]}},
    ]
    batches = read(spark, tmp_path, "metrics", metrics)
    rows = {(r.name, r.ts_nano): r for r in with_json(O.flatten_metrics(batches))}
    assert {k[0]: rows[k].type for k in rows} == {
        "g": "gauge", "s": "sum", "h": "histogram", "e": "exponential_histogram", "q": "summary"}
    assert (rows["g", 20].value, rows["g", 20].unit, fields(rows["g", 20])["description"]) == (1.5, "ms", "d")
    first, second = rows["s", 20], rows["s", 21]
    assert (first.temporality, first.monotonic, first.value, first.start_nano, second.start_nano) == ("cumulative", True, 4.0, 10, None)
    assert first.stream_id == second.stream_id and first.id == f"{first.stream_id}-sum-10-20" and second.id.endswith("-sum-0-21")
    assert rows["h", 20].value is None and json.loads(rows["h", 20].raw)["data_point"]["bucket_counts"] == [1, 2]
    assert O.reject_counts(O.rejects(batches, "metrics")).collect() == [("otlp.invalid_metric_point", 1)]


def histogram(**point):
    return {"name": "h", "histogram": {"aggregation_temporality": 1, "data_points": [{**POINT, **point}]}}


def exponential(temporality=1, **point):
    return {"name": "e", "exponential_histogram": {"aggregation_temporality": temporality, "data_points": [{**POINT, **point}]}}


def summary(*quantiles):
    return {"name": "q", "summary": {"data_points": [
        {**POINT, "quantile_values": [{"quantile": q, "value": v} for q, v in quantiles]}]}}


def gauge(**point):
    return {"name": "g", "gauge": {"data_points": [{**POINT, "as_double": 1.0, **point}]}}


POINTS = [
    (histogram(count=3), True),
    (histogram(count=3, bucket_counts=[1, 2], explicit_bounds=[1.0]), True),
    (histogram(count=4, bucket_counts=[1, 2], explicit_bounds=[1.0]), False),
    (histogram(count=3, bucket_counts=[3]), True),
    (histogram(count=3, bucket_counts=[1, 2], explicit_bounds=[]), False),
    (histogram(count=3, bucket_counts=[1, 1, 1], explicit_bounds=[2.0, 2.0]), False),
    (histogram(count=3, bucket_counts=[1, 1, 1], explicit_bounds=[2.0, 3.0]), True),
    (histogram(count=2**62, bucket_counts=[2**62, 2**62], explicit_bounds=[2.0]), False),
    (exponential(count=5, zero_count=1, positive={"bucket_counts": [2]}, negative={"bucket_counts": [1, 1]}), True),
    (exponential(count=6, zero_count=1, positive={"bucket_counts": [2]}), False),
    (exponential(0, count=0), False),
    (summary((0.1, 1.0), (0.9, 1.0)), True), (summary((0.9, 1.0), (0.1, 1.0)), False), (summary((1.5, 1.0)), False), (summary(), True),
    (gauge(), True), (gauge(time_unix_nano=0), False), (gauge(start_time_unix_nano=30), False), ({**gauge(), "name": ""}, False),
    ({"name": "s", "sum": {"aggregation_temporality": 0, "data_points": [{**POINT, "as_int": 1}]}}, False),
]


def test_point_validation(spark, tmp_path):
    marked = [{**m, "description": str(i)} for i, (m, _) in enumerate(POINTS)]
    rows = O.points_of(read(spark, tmp_path, "metrics", marked)).select("metric.description", "valid").collect()
    assert {int(r.description): r.valid for r in rows} == {i: ok for i, (_, ok) in enumerate(POINTS)}


def span(**more):
    return {"trace_id": b64(TRACE), "span_id": b64(SPAN), "name": "n", "start_time_unix_nano": 1, "end_time_unix_nano": 1, **more}


SPANS = [(span(), True), (span(name=""), False), (span(end_time_unix_nano=0), False), (span(trace_id=b64(bytes(16))), False),
         (span(span_id=b64(SPAN[:7])), False), (span(parent_span_id=b64(bytes(8))), False), (span(parent_span_id=b64(SPAN)), True),
         (span(parent_span_id=""), True)]


def test_span_validation(spark, tmp_path):
    marked = [{**s, "trace_state": str(i)} for i, (s, _) in enumerate(SPANS)]
    rows = O.spans_of(read(spark, tmp_path, "traces", marked)).select("span.trace_state", "valid").collect()
    assert {int(r.trace_state): r.valid for r in rows} == {i: ok for i, (_, ok) in enumerate(SPANS)}


@pytest.mark.parametrize("value, shown", [
    ({"double_value": 1.5}, "1.5"), ({"int_value": "-9007199254740993"}, "-9007199254740993"), ({"int_value": "7x"}, '"7x"'),
    ({"double_value": "2.5"}, "2.5"), ({"array_value": {"values": [{"int_value": 5}, {"int_value": "5"}, {"double_value": "1.5"}]}}, "[5,5,1.5]"),
    ({"bool_value": False}, "false"), ({"bytes_value": b64(b"\x01\xff")}, '"01ff"'), ({}, "null"),
    ({"array_value": {"values": [{"int_value": 1}, {"array_value": {"values": [{"int_value": 2}]}}]}}, "[1,[2]]"),
])
def test_any_value(spark, value, shown):
    from signaldeck.sources.otel import any_value_ddl

    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.from_json("j", any_value_ddl()).alias("v"))
    assert df.select(F.to_json(O.any_value(F.col("v")))).first()[0] == shown


def wrapped(value, *kinds):
    """Wire and decoded form of a value within arrays ('a') and key-value lists ('k'), outermost first."""
    wire, shown = value
    for kind in reversed(kinds):
        if kind == "a":
            wire, shown = {"array_value": {"values": [wire, {"int_value": 1}]}}, [shown, 1]
        else:
            entry = {"value": wire, "key": "k"}
            wire, shown = {"kvlist_value": {"values": [entry, entry]}}, [{"key": "k", "value": shown}] * 2
    return wire, shown


TRICKY = 'a "]}}" \\ {"int_value":7} \\" ,"x_value":null} é \u2028 \n'
SCALARS = [
    ({"string_value": TRICKY}, TRICKY), ({"string_value": ""}, ""), ({"int_value": 2**63 - 1}, 2**63 - 1), ({"int_value": -7}, -7),
    ({"bool_value": False}, False), ({"double_value": 1.0}, 1.0), ({"double_value": 0.1}, 0.1), ({"double_value": -2.5e300}, -2.5e300),
    ({"double_value": "NaN"}, "NaN"), ({"double_value": "-Infinity"}, "-Infinity"), ({"bytes_value": b64(b"\x01\xff\xfb")}, "01fffb"),
    ({}, None), ({"string_value": None, "int_value": 4, "bool_value": None}, 4), ({"string_value": None, "bool_value": None}, None),
    ({"array_value": {"values": []}}, []), ({"kvlist_value": {"values": []}}, []),
    ({"kvlist_value": {"values": [{"key": TRICKY}]}}, [{"key": TRICKY, "value": None}]),
]


@pytest.mark.parametrize("kinds", ["a", "k", "aak", "kkk", "kaakaka", "a" * 60 + "k" * 5])
def test_any_value_of_any_depth(spark, kinds):
    from signaldeck.sources.otel import any_value_ddl

    values = [wrapped(v, *kinds) for v in SCALARS]
    rows = [(i, json.dumps(wire, indent=1)) for i, (wire, _) in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.from_json("j", any_value_ddl()).alias("v"))
    got = {r.i: r.j for r in df.select("i", F.to_json(O.any_value(F.col("v"))).alias("j")).collect()}
    # repr tells 1 from 1.0 and True.
    assert [repr(json.loads(got[i])) for i in got] == [repr(values[i][1]) for i in got] and len(got) == len(SCALARS)


def test_deep_values_in_records(spark, tmp_path):
    (wire, shown) = wrapped(({"string_value": "x"}, "x"), *"akak")
    log = {"body": wire, "time_unix_nano": 8, "attributes": [{"key": "deep", "value": wire}]}
    row, = with_json(O.otel_logs(read(spark, tmp_path, "logs", [log])))
    assert json.loads(row.message) == shown and fields(row)["attribute.deep"] == shown
    raw = next(part for part in json.loads(row.raw).values() if "body" in part)
    assert raw["body"] == shown and raw["attributes"] == [{"key": "deep", "value": shown}]


def test_deep_values_in_typed_files(spark, tmp_path):
    scalar = "struct<string_value: string, int_value: bigint, bytes_value: binary"
    inner = f"struct<values: array<{scalar}, array_value: string>>>"
    value = f"{scalar}, array_value: {inner}>"
    log = f"struct<time_unix_nano: bigint, body: {value}, attributes: array<struct<key: string, value: {value}>>>"
    schema = f"resource_logs array<struct<scope_logs: array<struct<log_records: array<{log}>>>>>"
    text = json.dumps({"values": [wrapped(({"string_value": TRICKY}, TRICKY), "a", "k")[0]]})
    body = {"array_value": {"values": [{"array_value": text}, {"bytes_value": bytearray(b"\x01\xff")}]}}
    requests = [([{"scope_logs": [{"log_records": [{"time_unix_nano": 8, "body": body, "attributes": [{"key": "d", "value": body}]}]}]}],)]
    spark.createDataFrame(requests, schema).write.parquet(str(tmp_path / "p"))
    row, = with_json(O.otel_logs(read_otel(spark, str(tmp_path / "p"), "logs", 1, 9, format="parquet")))
    shown = [[[[{"key": "k", "value": TRICKY}] * 2, 1]], "01ff"]
    assert json.loads(row.message) == shown and fields(row)["attribute.d"] == shown


def test_integers_as_text(spark, tmp_path):
    point = {"time_unix_nano": "9007199254740993", "count": "3", "sum": 6.0, "bucket_counts": ["1", "2"], "explicit_bounds": [1.0]}
    metric = {"name": 'say "count":"5"', "histogram": {"data_points": [point], "aggregation_temporality": 1}}
    row, = with_json(O.flatten_metrics(read(spark, tmp_path, "metrics", [metric])))
    assert row.ts_nano == 9007199254740993 and row.name == 'say "count":"5"'
    raw = json.loads(row.raw)
    assert "[1, 2]" in json.dumps(raw) and '"count": 3' in json.dumps(raw)


def test_merged_maps_and_pairs_keep_their_order_of_precedence(spark):
    rows = spark.range(1).select(
        V.merge(F.expr("map('a', null, 'b', parse_json('1'))"), F.expr("map('a', parse_json('2'), 'b', parse_json('3'))"),
                F.expr("map('c', parse_json('4'))")).cast("map<string,string>").alias("first"),
        V.merge(F.expr("map('a', parse_json('1'))"), F.expr("cast(null as map<string,variant>)")).isNull().alias("none"),
        V.map_of_pairs(F.expr("array(struct('a' as key, parse_json('1') as value), struct('a' as key, parse_json('2') as value))"))
        .cast("map<string,string>").alias("last"),
    ).first()
    assert rows.first == {"a": "2", "b": "1", "c": "4"} and rows.none and rows.last == {"a": "2"}


def test_raw_forms_are_left_out_where_no_raw_text_is_asked_for(spark, tmp_path):
    """Each is computed once per scope, below the explode of the spans, and pruned with ``raw``."""
    rows = O.span_exceptions(spark.createDataFrame([], f"project_id bigint, received_at_ms bigint, {otel_ddl('traces')}"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "_resource" in plan(rows.select("id", "raw"))
    assert "_resource" not in plan(rows.select("id", "fields"))
    assert plan(rows.select("id", "raw")).count("Generate") == plan(rows.select("id", "fields")).count("Generate")
