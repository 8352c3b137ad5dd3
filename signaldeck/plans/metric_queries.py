"""Metric series queries over events seen as samples of one metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from signaldeck.operators import metrics as M
from signaldeck.operators import search as Q
from signaldeck.plans import views as v
from signaldeck.plans.registry import query
from signaldeck.schema import event_ms

START, END, DAY = 1704067200000 + 3_600_000, 1706659200000, 86_400_000
BUCKET = f"({START} + (event_ms - {START}) // {DAY} * {DAY})"
RANGE = f"event_ms BETWEEN {START} AND {END}"


def request(aggregate: str, **more) -> M.MetricQuery:
    return M.MetricQuery(0, "event.value", aggregate, START, END, interval_ms=DAY, **more)


def series(spark, d, aggregate: str, metric_type: str = "distribution", digits: int = 6, **more):
    """Series rows with values rounded to what floating-point sums agree on."""
    rows = M.metric_series(v.ev_metrics(spark, d, metric_type), request(aggregate, **more))
    return rows.withColumn("value", F.round("value", digits))


def grouped_sql(value: str, digits: int = 6) -> str:
    return f"""SELECT event_type AS group_0, {BUCKET} AS bucket_ms, round({value}, {digits}) AS value FROM em
  WHERE {RANGE} GROUP BY ALL"""


@query("metric_percentiles", v.EM, sql=grouped_sql("quantile_cont(value, 0.95)"))
def _(spark, d):
    return series(spark, d, "p95", group_by=("event_type",))


for _name, _p in M.PERCENTILES.items():
    query(f"metric_{_name}", v.EM, sql=grouped_sql(f"quantile_cont(value, {_p})"))(
        lambda spark, d, name=_name: series(spark, d, name, group_by=("event_type",))
    )


@query("metric_percentiles_ranked", v.EM, sql=f"""SELECT event_type, {BUCKET} AS bucket_ms,
  round(quantile_cont(value, 0.99), 6) AS value FROM em GROUP BY ALL""")
def _(spark, d):
    rows = v.ev_metrics(spark, d).select(
        M.group_label(M.group_key("event_type")).alias("event_type"),
        M.bucket(event_ms(), START, DAY).alias("bucket_ms"), "value",
    )
    return M.exact_percentile(rows, ["event_type", "bucket_ms"], 0.99).withColumn("value", F.round("value", 6))


@query("metric_sum", v.EM, sql=grouped_sql("sum(value)"))
def _(spark, d):
    return series(spark, d, "sum", group_by=("event_type",))


@query("metric_increase", v.EM, sql=f"""SELECT {BUCKET} AS bucket_ms, round(sum(value), 6) AS value FROM em
  WHERE {RANGE} GROUP BY ALL""")
def _(spark, d):
    return series(spark, d, "increase", "sum")


@query("metric_count", v.EM, sql=grouped_sql("CAST(count(*) AS DOUBLE)"))
def _(spark, d):
    return series(spark, d, "count", group_by=("event_type",))


@query("metric_avg", v.EM, sql=grouped_sql("sum(value) / count(*)"))
def _(spark, d):
    return series(spark, d, "avg", group_by=("event_type",))


@query("metric_min", v.EM, sql=grouped_sql("min(value)"))
def _(spark, d):
    return series(spark, d, "min", group_by=("event_type",))


@query("metric_max", v.EM, sql=grouped_sql("max(value)"))
def _(spark, d):
    return series(spark, d, "max", group_by=("event_type",))


@query("metric_latest", v.EM, sql=grouped_sql("arg_max(value, struct_pack(ts_nano, id))"))
def _(spark, d):
    return series(spark, d, "latest", "gauge", group_by=("event_type",))


for _name, _type, _sql in (
    ("per_second", "distribution", f"count(*) * 1000.0 / {DAY}"),
    ("per_minute", "distribution", f"count(*) * 60000.0 / {DAY}"),
    ("rate_per_second", "sum", f"sum(value) * 1000.0 / {DAY}"),
    ("rate_per_minute", "sum", f"sum(value) * 60000.0 / {DAY}"),
):
    query(f"metric_{_name}", v.EM, sql=grouped_sql(_sql, digits=9))(
        lambda spark, d, name=_name, kind=_type: series(
            spark, d, name, kind, digits=9, group_by=("event_type",)
        )
    )


TOP = f"""tg AS (SELECT k, event_type, sum(value) AS r FROM em WHERE {RANGE} GROUP BY k, event_type
  ORDER BY r DESC, event_type, CAST(k AS VARCHAR) LIMIT 7)"""


@query("metric_top_groups", v.EM, TOP, sql=f"""SELECT event_type AS group_0, CAST(k AS VARCHAR) AS group_1,
  {BUCKET} AS bucket_ms, round(sum(value), 6) AS value FROM em JOIN tg USING (event_type, k)
  WHERE {RANGE} GROUP BY ALL""")
def _(spark, d):
    return series(spark, d, "sum", group_by=("event_type", "k"), group_limit=7)


TOPP = f"""tp AS (SELECT k, quantile_cont(value, 0.75) AS r FROM em WHERE {RANGE} GROUP BY k
  ORDER BY r DESC, CAST(k AS VARCHAR) LIMIT 5)"""


@query("metric_top_percentile", v.EM, TOPP, sql=f"""SELECT CAST(k AS VARCHAR) AS group_0,
  {BUCKET} AS bucket_ms, round(quantile_cont(value, 0.75), 6) AS value FROM em JOIN tp USING (k)
  WHERE {RANGE} GROUP BY ALL""")
def _(spark, d):
    return series(spark, d, "p75", group_by=("k",), group_limit=5)


@query("metric_null_group", v.EM, sql=f"""SELECT CASE WHEN k < 50 THEN CAST(k % 3 AS VARCHAR) END AS group_0,
  {BUCKET} AS bucket_ms, CAST(count(*) AS DOUBLE) AS value FROM em WHERE {RANGE} GROUP BY ALL""")
def _(spark, d):
    k = Q.V.as_bigint(Q.variant_field("k"))
    fields = Q.V.field_map(("attribute.shard", Q.V.of(F.when(k < 50, k % 3))))
    records = v.ev_metrics(spark, d).withColumn("fields", F.to_variant_object(fields))
    return M.metric_series(records, request("count", group_by=("shard",)))


@query("metric_predicate", v.EM, sql=f"""SELECT event_type AS group_0, {BUCKET} AS bucket_ms,
  CAST(count(*) AS DOUBLE) AS value FROM em WHERE {RANGE} AND event_type <> 'error' AND k IN (3, 14, 15)
  GROUP BY ALL""")
def _(spark, d):
    keep = Q.all_of(Q.not_(Q.eq("event_type", "error")), Q.in_("k", [3, 14, 15]))
    return series(spark, d, "count", group_by=("event_type",), predicate=keep)


@query("metric_bucket", v.EM, sql=f"""SELECT id, {START} + (event_ms - {START}) // 900000 * 900000 AS bucket_ms
  FROM em WHERE {RANGE}""")
def _(spark, d):
    rows = v.ev_metrics(spark, d).filter(Q.time_range(START, END))
    return rows.select("id", M.bucket(event_ms(), START, 900_000).alias("bucket_ms"))


@query("metric_identities", v.EV, sql="""SELECT CASE WHEN name = 'error' THEN 'sum' ELSE 'gauge' END AS type,
  CASE WHEN level = 'debug' THEN 'ms' END AS unit, count(*) AS samples FROM ev GROUP BY ALL""")
def _(spark, d):
    rows = v.ev_records(spark, d).withColumns({
        "type": F.when(F.col("name") == "error", "sum").otherwise("gauge"),
        "unit": F.when(F.col("level") == "debug", "ms"),
    })
    return M.identities(rows)


@query("metric_point_cap", v.EM, sql=f"""SELECT group_0, bucket_ms, value, true AS truncated FROM (
  SELECT event_type AS group_0, {BUCKET} AS bucket_ms, CAST(count(*) AS DOUBLE) AS value,
    count(*) OVER () AS x FROM em WHERE {RANGE} GROUP BY ALL)
  JOIN (SELECT event_type AS group_0, count(*) AS r FROM em WHERE {RANGE} GROUP BY ALL) USING (group_0)
  ORDER BY r DESC, group_0, bucket_ms LIMIT 40""")
def _(spark, d):
    query_ = request("count", group_by=("event_type",))
    return M.truncated_series(v.ev_metrics(spark, d), query_, max_points=40)


@query("metric_cards", v.EV, sql="""SELECT name, 'metric' AS type, 'value' AS unit,
  arg_max(value, struct_pack(ts_nano, id)) AS latest_value, count(*) AS samples,
  (SELECT string_agg(CAST(CAST(round(x.value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY x.ts_nano, x.id) FROM (
     SELECT * FROM ev e2 WHERE e2.name = ev.name ORDER BY ts_nano DESC, id DESC LIMIT 24) x) AS recent
  FROM ev GROUP BY name""")
def _(spark, d):
    cards = M.metric_cards(v.ev_records(spark, d))
    cents = F.transform("recent_values", lambda x: F.round(x * 100).cast("bigint").cast("string"))
    return cards.select("name", "type", "unit", "latest_value", "samples", F.array_join(cents, ",").alias("recent"))
