"""Envelope framing, validation, canonical fields and ids."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from signaldeck.operators import envelopes as E
from signaldeck.operators import otel
from signaldeck.sources.envelopes import frame_envelopes, read_envelopes, split_body

EVENT_ID = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"


def body(header, *items, length=True):
    lines = [json.dumps(header)]
    for item_header, payload in items:
        text = payload if isinstance(payload, str) else json.dumps(payload)
        item_header = dict(item_header)
        if length:
            item_header["length"] = len(text.encode())
        lines += [json.dumps(item_header), text]
    return "\n".join(lines).encode()


def framed(spark, *bodies, received=2):
    rows = [(f"e{i}", 1, received, bytearray(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(
        rows, "envelope_id string, project_id bigint, received_at_ms bigint, body binary"
    )
    return frame_envelopes(df)


def fields_of(df):
    return [json.loads(r[0]) for r in df.select(F.to_json("fields")).collect()]


def batch(kind, *entries, count=None):
    header = {"type": kind, "item_count": len(entries) if count is None else count}
    return header, {"version": 2, "items": list(entries)}


LOG = {"timestamp": 1_700_000_100.5, "level": "warn", "body": "queue is filling up", "trace_id": "7" * 32,
       "attributes": {"logger.name": {"value": "ingest", "type": "string"}, "depth": {"value": 93, "type": "integer"},
                      "sentry.environment": {"value": "blue", "type": "string"}}}


def metric(kind, value, **more):
    return {"timestamp": 1_700_000_101, "name": f"orders.{kind}", "type": kind, "value": value, "trace_id": "8" * 32,
            "attributes": {}, **more}


def test_error_event(spark):
    envelopes = framed(spark, body({"event_id": EVENT_ID}, ({"type": "event"}, {"event_id": EVENT_ID, "timestamp": 1})))
    row = E.events_to_errors(envelopes).first()
    assert (row.id, row.signal, row.source, row.level) == (EVENT_ID, "error", "sentry", "error")
    assert row.ts_nano == 1_000_000_000 and row.source_id == EVENT_ID and row.title == "Error"


def test_items_of_one_envelope(spark):
    two_logs = batch("log", LOG, {**LOG, "body": "queue is full", "level": "fatal"})
    points = batch("trace_metric", metric("counter", 12), metric("gauge", -0.25, unit="percent"), metric("distribution", 1e3))
    envelopes = framed(spark, body({}, ({"type": "profile"}, "-"), points, two_logs, ({"type": "profile"}, "-")))
    rows = E.envelope_records(envelopes).collect()
    logs = sorted((r.message, r.level, r.logger, r.environment, r.ts_nano) for r in rows if r.signal == "log")
    at = 1_700_000_100_500_000_000
    assert logs == [("queue is filling up", "warn", "ingest", "blue", at), ("queue is full", "fatal", "ingest", "blue", at)]
    kinds = {r.name: (r.type, r.value, r.unit, r.temporality, r.monotonic) for r in rows if r.signal == "metric"}
    assert kinds["orders.counter"] == ("sum", 12.0, None, "delta", True)
    assert kinds["orders.gauge"][:3] == ("gauge", -0.25, "percent")
    assert kinds["orders.distribution"][:2] == ("distribution", 1000.0)
    assert {r.reason: r.rejected for r in otel.reject_counts(E.rejects(envelopes)).collect()} == {"profile": 2}


@pytest.mark.parametrize("bad", [
    batch("log", LOG, count=2),
    batch("log", {**LOG, "level": "loud"}),
    batch("log", {k: v for k, v in LOG.items() if k != "trace_id"}),
    batch("trace_metric", metric("gauge", "3.5")),
    batch("trace_metric", metric("histogram", 3.5)),
    ({"type": "event"}, {"event_id": "not-a-uuid"}),
    ({"type": "event"}, {"event_id": EVENT_ID, "timestamp": "yesterday"}),
    ({"type": "event"}, {"event_id": EVENT_ID, "timestamp": -1}),
    ({"type": "event"}, "not json"),
    ({"kind": "event"}, {"event_id": EVENT_ID}),
])
def test_one_bad_item_rejects_the_envelope(spark, bad):
    envelopes = framed(spark, body({}, batch("log", LOG), bad), body({}, batch("log", LOG)))
    assert E.envelope_records(envelopes).count() == 1
    assert [r.reason for r in E.rejects(envelopes).collect()] == ["malformed"]


def test_event_ids_must_agree(spark):
    dashed = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"
    same = body({"event_id": dashed}, ({"type": "event"}, {"event_id": EVENT_ID}))
    other = body({"event_id": dashed}, ({"type": "event"}, {"event_id": "1" * 32}))
    rows = E.events_to_errors(framed(spark, same, other)).collect()
    assert [r.id for r in rows] == [EVENT_ID]


def test_framing(spark):
    pretty = json.dumps({"event_id": EVENT_ID, "message": "two\nlines"}, indent=1)
    with_newlines = body({}, ({"type": "event"}, pretty))
    no_length = body({}, ({"type": "event"}, {"event_id": EVENT_ID}), length=False) + b"\n"
    zipped = gzip.compress(no_length)
    short = b'{}\n{"type":"event","length":900}\n{}'
    blank = b"{}\n\n"
    envelopes = framed(spark, with_newlines, no_length, zipped, short, blank)
    ok = {r.envelope_id: r.valid for r in E.validate_envelopes(envelopes).collect()}
    assert ok == {"e0": True, "e1": True, "e2": True, "e3": False, "e4": False}
    header, items, error = split_body(with_newlines)
    assert error is None and json.loads(items[0]["payload"])["message"] == "two\nlines"


def test_bytes_that_are_no_text_and_lengths_that_are_no_number(spark):
    for bad in (b'{}\n{"type":"event","length":3}\n"\xff"', b'{}\n{"type":"event","length":true}\n1'):
        assert split_body(bad)[2] is not None
        assert [r.valid for r in E.validate_envelopes(framed(spark, bad)).collect()] == [False]


def test_read_envelopes_from_files(spark, tmp_path):
    (tmp_path / "a.envelope").write_bytes(body({}, batch("log", LOG)))
    (tmp_path / "b.envelope.gz").write_bytes(gzip.compress(body({}, batch("log", LOG, LOG))))
    rows = E.envelope_records(read_envelopes(spark, str(tmp_path), 7, 5)).collect()
    assert len(rows) == 3 and {r.project_id for r in rows} == {7}


def test_size_limits_and_cut_off_bodies(spark):
    plain = body({}, *[batch("log", LOG)] * 3)
    packed = gzip.compress(plain)
    assert split_body(plain, len(plain))[2] is None and split_body(packed, len(plain))[2] is None
    assert split_body(plain, len(plain) - 1)[2] == split_body(packed, len(plain) - 1)[2] == "body too large"
    assert split_body(gzip.compress(bytes(50_000_000)), 1000)[2] == "body too large"
    assert split_body(packed[:-9])[2] == "compressed body is cut off"
    assert split_body(gzip.compress(plain[:40]) + gzip.compress(plain[40:])) == split_body(plain)
    whole = framed(spark, plain)
    assert whole.first().frame_error is None
    df = spark.createDataFrame([("e", 1, 2, bytearray(plain))], "envelope_id string, project_id bigint, received_at_ms bigint, body binary")
    assert frame_envelopes(df, 10).first().frame_error == "body too large"


def test_ids_are_stable_and_distinct(spark):
    one = body({}, batch("log", LOG, LOG))
    ids = [r.id for r in E.explode_items(framed(spark, one, one), "log").collect()]
    assert len(ids) == 4 and len(set(ids)) == 2


CANONICAL = [
    ({"request": {"method": "PUT", "url": "http://shop.local/cart/9"}}, {"http.method": "PUT", "http.url": "http://shop.local/cart/9"}),
    ({"request": {"query_string": "page=2&sort=up", "cookies": {"theme": "dark"}}},
     {"http.query": "page=2&sort=up", "http.cookies": {"theme": "dark"}}),
    ({"request": {"headers": [["Accept", "*/*"]], "data": [1, 2]}}, {"http.headers": [["Accept", "*/*"]], "http.body": [1, 2]}),
    ({"user": {"id": 7001, "ip_address": "10.9.8.7", "plan": "free"}},
     {"user.id": 7001, "user.ip": "10.9.8.7", "user.ip_address": "10.9.8.7", "user.plan": "free"}),
    ({"tags": {"shelf": "b4"}, "attributes": {"shelf": "c1", "slots": {"value": 12}}},
     {"tag.shelf": "b4", "attribute.shelf": "b4", "attribute.slots": 12}),
    ({"sdk": {"name": "own.sdk", "integrations": []}}, {"sdk.name": "own.sdk", "sdk.integrations": []}),
    ({"contexts": {"trace": {"op": "cart.add"}, "device": {"model": "till-3"}}},
     {"trace.op": "cart.add", "context.device": {"model": "till-3"}}),
    ({"breadcrumbs": {"values": [{"message": "opened"}, {"message": "paid"}]}}, {"breadcrumbs": [{"message": "opened"}, {"message": "paid"}]}),
]


@pytest.mark.parametrize("raw, expected", CANONICAL)
def test_canonical_fields(spark, raw, expected):
    df = E.events_to_errors(framed(spark, body({}, ({"type": "event"}, {"event_id": EVENT_ID, **raw}))))
    fields = fields_of(df)[0]
    assert {k: fields.get(k) for k in expected} == expected and "context.trace" not in fields
    assert json.loads(df.first().raw) == {"event_id": EVENT_ID, **raw}


@pytest.mark.parametrize("own, trace", [({}, "6" * 32), ({"contexts": {"trace": {"trace_id": "5" * 32}}}, "5" * 32)])
def test_header_fills_what_the_event_lacks(spark, own, trace):
    header = {"event_id": EVENT_ID, "trace": {"trace_id": "6" * 32, "environment": "green", "release": "shop@4"}}
    df = E.events_to_errors(framed(spark, body(header, ({"type": "event"}, {"event_id": EVENT_ID, **own}))))
    row = df.first()
    assert (row.trace_id, row.environment, row.release) == (trace, "green", "shop@4")
    assert "environment" not in fields_of(df)[0]


def test_tags_as_pairs_and_typed_promotion(spark):
    raw = {"event_id": EVENT_ID, "tags": [["a", 1], ["a", 2], [3, 4], ["b"]], "level": 5}
    df = E.events_to_errors(framed(spark, body({}, ({"type": "event"}, raw))))
    fields = fields_of(df)[0]
    assert fields["tag.a"] == 2 and fields["attribute.a"] == 2 and "tag.b" not in fields
    assert df.first().level is None and fields["level"] == 5


def test_last_exception_of_a_chain_names_the_error(spark):
    def raised(kind, text, *frames, **mechanism):
        return {"type": kind, "value": text, "mechanism": mechanism, "stacktrace": {"frames": list(frames)}}

    outer = {"filename": "till.rb", "function": "pay", "lineno": 310, "module": "shop.till", "in_app": True, "vars": {"sum": "9.50"}}
    inner = {"filename": "socket.rb", "abs_path": "/usr/lib/socket.rb", "function": "read", "colno": 2, "in_app": False}
    chain = [raised("Timeout", "no answer", inner, type="link", handled=True), raised("Refused", "", inner),
             raised("PaymentFailed", "card 7", outer, inner, type="hook", handled=False)]
    df = E.events_to_errors(framed(spark, body({}, ({"type": "event"}, {"event_id": EVENT_ID, "exception": {"values": chain}}))))
    row, fields = df.first(), fields_of(df)[0]
    assert (row.error_type, row.error_value, row.error_handled, row.message) == ("PaymentFailed", "card 7", False, "card 7")
    assert row.title == "PaymentFailed: card 7" and row.issue_fingerprint == "PaymentFailed\0shop.till\0pay\0till.rb"
    assert [e["type"] for e in fields["error.exceptions"]] == ["PaymentFailed", "Refused", "Timeout"]
    first, _, last = fields["error.exceptions"]
    assert first["frames"] == [
        {"filename": "till.rb", "function": "pay", "line": 310, "module": "shop.till", "in_app": True, "variables": {"sum": "9.50"}},
        {"filename": "socket.rb", "path": "/usr/lib/socket.rb", "function": "read", "column": 2, "in_app": False}]
    assert (last["message"], last["mechanism"], last["handled"], len(last["frames"])) == ("no answer", "link", True, 1)
    assert set(fields["stack.filename"]) == {"till.rb", "socket.rb"}


@pytest.mark.parametrize("raw, fingerprint, title", [
    ({"fingerprint": ["a", "b", 3]}, "a\0b", "Error"),
    ({"fingerprint": [], "logentry": {"message": "m %s", "formatted": "m 1"}}, "m %s", "m 1"),
    ({"message": "hello"}, "hello", "hello"),
    ({"exception": {"values": [{"type": "E"}]}}, "E", "E"),
    ({"exception": {"values": [{"type": "E", "stacktrace": {"frames": [{"function": "f"}, {"filename": "x"}]}}]}},
     "E\0\0\0x", "E"),
])
def test_issue_identity(spark, raw, fingerprint, title):
    df = E.events_to_errors(framed(spark, body({}, ({"type": "event"}, {"event_id": EVENT_ID, **raw}))))
    row = df.first()
    assert (row.issue_fingerprint, row.issue_title) == (fingerprint, title)


def test_stack_without_an_exception(spark):
    frames = [{"filename": "boot.js", "lineno": 1}, {"filename": "route.js", "lineno": 88, "in_app": True}]
    for raw in ({"stacktrace": {"frames": frames}}, {"stacktrace": {"frames": frames}, "exception": {"values": []}}):
        df = E.events_to_errors(framed(spark, body({}, ({"type": "event"}, {"event_id": EVENT_ID, **raw}))))
        entry, = fields_of(df)[0]["error.exceptions"]
        assert entry["type"] == "Stacktrace" and [f["line"] for f in entry["frames"]] == [1, 88]


@pytest.mark.parametrize("value, nano", [
    (1, 1_000_000_000), (1.5, 1_500_000_000), ("1970-01-01T00:00:01Z", 1_000_000_000),
    ("2024-01-02T03:04:05.123456789+00:00", 1704164645123456789), ("2024-01-02T03:04:05+02:00", 1704157445000000000),
    ("2024-01-02", None), (True, None), ("1969-12-31T23:59:59Z", None), ("9999-12-31T00:00:00Z", None), (1e300, None),
])
def test_event_time(spark, value, nano):
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(E.event_time(F.col("v"), F.lit(0))).first()[0] == nano
