"""Readers over files written from the driver tables; results equal those of the operators on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signaldeck.operators import ddtrace as D
from signaldeck.operators import metrics as M
from signaldeck.operators import otel as O
from signaldeck.plans import metric_queries as m
from signaldeck.plans import views as v
from signaldeck.plans import wire_queries as w
from signaldeck.plans.registry import ORACLES, query
from signaldeck.session import LineageCut
from signaldeck.sources.ddtrace import read_spans_v04, read_spans_v05
from signaldeck.sources.otel import read_otel


def as_json(spark, payloads, *columns: str) -> str:
    path = LineageCut(spark).new_path()
    payloads.select(*columns).write.json(path, compression="gzip")
    return path


@query("read_otel", sql=f"SELECT message_md5, level, service_name, lang, trace_id, span_id FROM ({ORACLES['flatten_logs']})")
def _(spark, d):
    """Export requests of logs as JSON files, their integers as text."""
    path = as_json(spark, w.doc_otel(spark, d), "resource_logs")
    return w.shown_logs(O.flatten_logs(read_otel(spark, path, "logs", 1, 9))).drop("ts_nano")


@query("read_spans_v04", sql=ORACLES["flatten_ddtrace"])
def _(spark, d):
    path = as_json(spark, w.dd_payloads(spark, d), "traces")
    return w.shown_spans(D.flatten_ddtrace(read_spans_v04(spark, path, 1, 9)))


@query("read_spans_v05", sql=ORACLES["expand_dictionary"])
def _(spark, d):
    path = as_json(spark, w.coded_payloads(spark, d), "dictionary", "traces")
    return w.shown_coded(read_spans_v05(spark, path, 1, 9))


AUTO = f"""st AS (SELECT CAST(min(s) AS BIGINT) AS step FROM (SELECT unnest({list(M.INTERVAL_LADDER_MS)}) AS s) WHERE s >= ceil(({m.END} - {m.START}) / 299.0))"""


@query("metric_auto_interval", v.EM, AUTO, sql=f"""SELECT event_type AS group_0, {m.START} + (event_ms - {m.START}) // step * step AS bucket_ms,
  round(max(value), 6) AS value FROM em, st WHERE {m.RANGE} GROUP BY ALL""")
def _(spark, d):
    """A series whose interval follows from its range."""
    request = M.MetricQuery(0, "event.value", "max", m.START, m.END, group_by=("event_type",))
    return M.metric_series(v.ev_metrics(spark, d), request).withColumn("value", F.round("value", 6))
