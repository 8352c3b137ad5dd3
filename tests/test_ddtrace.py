"""Trace-agent payloads read from JSON files."""

import json

import pytest

from signaldeck.operators import ddtrace as D
from signaldeck.operators.otel import reject_counts
from signaldeck.sources.ddtrace import read_spans_v04, read_spans_v05


def span(**more):
    return {"service": "web", "name": "op", "resource": "GET /", "trace_id": 18, "span_id": 52, "parent_id": 0, "start": 100,
            "duration": 7, "error": 0, "meta": {}, "metrics": {}, "type": "http", **more}


def v04(spark, folder, *traces):
    (folder / "p.json").write_text(json.dumps({"traces": list(traces)}))
    return read_spans_v04(spark, str(folder), 3, 9)


def test_failed_span_gives_a_record_and_an_error(spark, tmp_path):
    meta = {"_dd.p.tid": "00000000000000FF", "error.type": "StockError", "error.msg": "none left", "env": "green", "version": "12",
            "both": "text", "error.stack": "line 1"}
    good, bad = span(span_id=3), span(span_id=255, parent_id=3, error=2, meta=meta, metrics={"both": -1.0})
    df = D.ddtrace_records(v04(spark, tmp_path, [good], [bad]))
    rows = {(r.signal, r.span_id): r for r in df.collect()}
    assert set(rows) == {("trace", f"{3:016x}"), ("trace", f"{255:016x}"), ("error", f"{255:016x}")}
    trace, error = rows["trace", f"{255:016x}"], rows["error", f"{255:016x}"]
    assert trace.trace_id == f"{255:016x}{18:016x}" and trace.parent_span_id == f"{3:016x}"
    assert (error.id, error.source_record_id) == (f"{trace.id}-error", trace.id)
    assert (error.title, error.environment, trace.span_status) == ("StockError: none left", "green", "error")
    got = [json.loads(r[0]) for r in df.where(f"span_id = '{255:016x}'").selectExpr("to_json(fields)").collect()]
    assert [(f["attribute.both"], f["resource.service.version"], f["span.status_message"]) for f in got] == [(-1.0, "12", "none left")] * 2
    assert json.loads(error.raw)["span"]["span_id"] == "255"


def test_negative_bigints_are_unsigned_ids(spark, tmp_path):
    row = D.flatten_ddtrace(v04(spark, tmp_path, [span(trace_id=-1, span_id=-2, parent_id=-3)])).first()
    assert (row.trace_id, row.span_id, row.parent_span_id) == ("f" * 16, "f" * 15 + "e", "f" * 15 + "d")
    assert json.loads(row.raw)["trace_id"] == str(2**64 - 1)


@pytest.mark.parametrize("field, value", [("trace_id", 0), ("span_id", 0), ("name", ""), ("start", -1), ("duration", -1)])
def test_invalid_spans_are_counted(spark, tmp_path, field, value):
    payload = v04(spark, tmp_path, [span(**{field: value}), span()])
    assert D.ddtrace_records(payload).count() == 1
    assert reject_counts(D.rejects(payload)).collect() == [("ddtrace.invalid_span", 1)]


def test_error_without_details(spark, tmp_path):
    rows = D.ddtrace_errors(v04(spark, tmp_path, [span(error=1)], [span(error=1, span_id=9, resource="")])).collect()
    assert {r.title for r in rows} == {"Error: GET /", "Error"}


def test_words_that_repeat_in_a_dictionary(spark, tmp_path):
    words = ["", "shop", "pay", "k", "k", "old", "new"]
    coded = {"service": 1, "name": 2, "resource": 2, "trace_id": 1, "span_id": 2, "parent_id": 0, "start": 1, "duration": 2,
             "error": 0, "meta": {"3": 5, "4": 6}, "metrics": {"3": 1.5, "4": 2.5}, "type": 0}
    (tmp_path / "p.json").write_text(json.dumps({"dictionary": words, "traces": [[coded]]}))
    row = D.expand_dictionary(read_spans_v05(spark, str(tmp_path), 3, 9)).first()
    assert row.traces[0][0].meta == {"k": "new"} and row.traces[0][0].metrics == {"k": 2.5}


def test_dictionary(spark, tmp_path):
    words = ["", "web", "op", "GET /", "env", "prod", "m"]
    coded = {"service": 1, "name": 2, "resource": 3, "trace_id": 18, "span_id": 52, "parent_id": 0, "start": 1, "duration": 2,
             "error": 0, "meta": {"4": 5}, "metrics": {"6": 1.5}, "type": 0}
    lines = [{"dictionary": words, "traces": [[coded]]}, {"dictionary": words, "traces": [[coded], [{**coded, "name": 7}]]},
             {"dictionary": words, "traces": [[{**coded, "meta": {"9": 1}}]]}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    payloads = read_spans_v05(spark, str(tmp_path), 3, 9)
    rows = D.ddtrace_records(D.expand_dictionary(payloads)).collect()
    assert len(rows) == 1 and (rows[0].name, rows[0].environment, rows[0].service_name) == ("op", "prod", "web")
    assert D.malformed_payloads(payloads).count() == 2
