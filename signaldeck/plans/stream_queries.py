"""Streaming queries: the driver tables as files that arrive in parts, with a restart after each.

Results go through file sinks in the shared folder; nothing is gathered on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.operators import metrics as M
from signaldeck.plans import views as v
from signaldeck.plans.registry import query, uuid5_sql
from signaldeck.session import shared_folder
from signaldeck.sources.archive import open_archive
from signaldeck.streaming import jobs as T
from signaldeck.streaming.intake import intake, release
from signaldeck.streaming.outcomes import OutcomeCounts, observe_outcomes, stored_outcomes
from signaldeck.streaming.rollups import MetricRollups


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/signaldeck-stream-{uuid.uuid4().hex}"


PARTS = 4


def parts_of(table: DataFrame, by_time: bool) -> list[DataFrame]:
    """The table in ``PARTS`` arrivals: in time order, or mixed, so that later ones hold old records."""
    if not by_time:
        number = F.pmod(F.xxhash64("id"), F.lit(PARTS))
        return [table.filter(number == i) for i in range(PARTS)]
    cuts = table.select(F.percentile_approx("ts_nano", [i / PARTS for i in range(1, PARTS)])).first()[0]
    bounds = [-(2**63), *cuts, 2**63 - 1]
    return [table.filter((F.col("ts_nano") > a) & (F.col("ts_nano") <= b)) for a, b in zip(bounds, bounds[1:])]


def arriving(spark: SparkSession, table: DataFrame, start, by_time: bool = False) -> None:
    """Run a stream over a table that arrives in parts; it is stopped and restarted between them.

    ``start`` makes the writer from the stream.
    """
    base = scratch(spark)
    for part in parts_of(table, by_time):
        part.write.mode("append").parquet(f"{base}/in")
        T.run_available(start(T.stream_records(spark, f"{base}/in", table.schema)), f"{base}/checkpoint")


def each_batch(handler):
    return lambda stream: stream.writeStream.foreachBatch(handler)


def appended(path: str, shape=lambda stream: stream):
    return lambda stream: shape(stream).writeStream.format("parquet").option("path", path).outputMode("append")


@query("stream_dedupe", v.DL, sql="SELECT DISTINCT project_id, source_id FROM dl")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.doc_logs(spark, d), each_batch(T.dedupe_upsert(base)))
    return spark.read.parquet(f"{base}/rows").select("project_id", "source_id")


@query("stream_dedupe_stateful", v.DL, sql="SELECT DISTINCT project_id, source_id FROM dl")
def _(spark, d):
    base = scratch(spark)
    shape = lambda stream: T.stream_dedupe(stream).select("project_id", "source_id")
    arriving(spark, v.doc_logs(spark, d), appended(base, shape))
    return spark.read.parquet(base)


DELTAS = """SELECT project_id, id, CAST(reading AS DOUBLE) AS cumulative_value,
  CAST(delta AS DOUBLE) AS value, violation FROM df"""
DELTA_COLUMNS = ["project_id", "id", "cumulative_value", "value", "violation"]


@query("stream_difference", v.CT, sql=DELTAS)
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ev_counter(spark, d), each_batch(T.difference_upsert(base)), by_time=True)
    return spark.read.parquet(f"{base}/rows").select(*DELTA_COLUMNS)


@query("stream_difference_stateful", v.CT, sql=DELTAS)
def _(spark, d):
    base = scratch(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    T.use_rocksdb(spark)
    try:
        shape = lambda stream: T.stream_difference(stream).select(*DELTA_COLUMNS)
        arriving(spark, v.ev_counter(spark, d), appended(base, shape), by_time=True)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(base)


@query("stream_issues", v.OE, sql=f"""SELECT project_id, {uuid5_sql(ids.ISSUE_NAMESPACE, 'fingerprint')} AS issue_id,
  title, level, first_seen_ms, last_seen_ms, total_seen, latest_record_id FROM iss""")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ord_errors(spark, d), each_batch(T.issue_upsert(base)))
    return T.stored_issues(spark, base).drop("retained_events")


HOUR = 3_600_000


@query("stream_metric_series", v.EM, sql=f"""SELECT event_ms // {HOUR} * {HOUR} AS bucket_ms, 'event.value' AS name,
    CAST(round(sum(value) * 100) AS BIGINT) AS cents, count(*) AS count, min(value) AS min, max(value) AS max
  FROM em GROUP BY ALL""")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ev_metrics(spark, d), each_batch(T.series_upsert(base, HOUR)))
    return T.stored_series(spark, base).select(
        "bucket_ms", "name", F.round(F.col("sum") * 100).cast("bigint").alias("cents"), "count", "min", "max",
    )


@query("stream_percentiles", v.EM, sql=f"""SELECT event_ms // {HOUR} * {HOUR} AS bucket_ms, 'event.value' AS name,
    round(quantile_cont(value, 0.95), 6) AS value
  FROM em GROUP BY ALL""")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ev_metrics(spark, d), each_batch(T.series_upsert(base, HOUR, by_value=True)))
    rows = M.percentile_of_counts(T.stored_value_counts(spark, base), ["bucket_ms", "name"], 0.95)
    return rows.withColumn("value", F.round("value", 6))


@query("stream_counters", v.EV, sql="SELECT 'accepted.' || signal AS name, count(*) AS value FROM ev GROUP BY signal")
def _(spark, d):
    base = scratch(spark)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(base)

    start = lambda stream: T.stream_counters(stream).writeStream.outputMode("complete").foreachBatch(keep)
    arriving(spark, v.ev_records(spark, d), start)
    return spark.read.parquet(base)


@query("change_feed", v.EV, sql="""SELECT project_id, signal, sequence FROM (SELECT DISTINCT project_id, signal FROM ev)
  CROSS JOIN (SELECT CAST(unnest(range(4)) AS BIGINT) AS sequence)""")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ev_records(spark, d), each_batch(T.change_log(base)))
    return spark.read.parquet(base).select("project_id", "signal", "sequence")


@query("stream_archive", v.EV, sql="""SELECT project_id, signal, CAST(make_date(CAST(received_at_ms // 86400000 AS INTEGER)) AS VARCHAR) AS date,
  count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ev GROUP BY ALL""")
def _(spark, d):
    base = scratch(spark)
    arriving(spark, v.ev_records(spark, d), each_batch(T.archive_upsert(base)))
    return open_archive(spark, base).groupBy(
        "project_id", "signal", F.col("date").cast("string").alias("date")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).alias("ids"))


INTAKE = f"""SELECT name, CAST(sum(value) AS BIGINT) AS value FROM (
  SELECT unnest(['accepted', 'accepted.log']) AS name, count(DISTINCT (project_id, source_id)) AS value FROM dl WHERE project_id <> 3
  UNION ALL SELECT unnest(['accepted', 'accepted.metric']), count(*) FROM df
  UNION ALL SELECT unnest(['accepted', 'accepted.error']), count(*) FROM oe
  UNION ALL SELECT unnest(['skipped', 'skipped.inactive_project']), count(*) FROM dl WHERE project_id = 3
  UNION ALL SELECT unnest(['skipped', 'skipped.duplicate']), count(*) - count(DISTINCT (project_id, source_id)) FROM dl WHERE project_id <> 3
  UNION ALL SELECT 'metric.cumulative_sum_monotonic_decrease', count(*) FROM df WHERE violation
) GROUP BY name HAVING sum(value) > 0"""


@query("intake", v.DL, v.CT, v.OE, sql=INTAKE)
def _(spark, d):
    """Logs with copies, counter readings and errors arrive in time order; region 3 is no active project."""
    base = scratch(spark)
    status = F.when(F.col("r_regionkey") == 3, "deleting").otherwise("active").alias("status")
    projects = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("project_id"), status)
    # Orders span years: arrivals by the year keep the archive to a few partitions.
    year = F.col("received_at_ms") - F.pmod("received_at_ms", F.lit(31_536_000_000))
    errors = v.ord_errors(spark, d).withColumn("received_at_ms", year)
    records = v.doc_logs(spark, d).unionByName(v.ev_counter(spark, d)).unionByName(errors)
    arriving(spark, records, each_batch(intake(base, projects)), by_time=True)
    return spark.read.parquet(f"{base}/counts").groupBy("name").agg(F.sum("value").cast("bigint").alias("value"))


CUT, OLD = 1705276800000, 1704585600000
RETURNED = f"""SELECT 0 AS batch, 'accepted' AS name, count(*) AS value FROM ev WHERE signal = 'error' AND received_at_ms < {CUT}
  UNION ALL SELECT 1, 'accepted', count(*) FROM ev WHERE signal = 'error' AND (received_at_ms >= {CUT} OR received_at_ms < {OLD})
  UNION ALL SELECT 1, 'skipped.duplicate', count(*) FROM ev WHERE signal = 'error' AND received_at_ms >= {OLD} AND received_at_ms < {CUT}"""


@query("evict_and_return", v.EV, sql=RETURNED)
def _(spark, d):
    """Errors are taken in, the oldest evicted, and all errors sent again: what was evicted is accepted a second time."""
    base, errors = scratch(spark), v.ev_records(spark, d).filter("signal = 'error'")
    projects = spark.range(3).select(F.col("id").alias("project_id"), F.lit("active").alias("status"))
    take = intake(base, projects)
    take(errors.filter(F.col("received_at_ms") < CUT), 0)
    release(spark, base, errors.filter(F.col("received_at_ms") < OLD))
    take(errors, 1)
    counts = spark.read.parquet(f"{base}/counts").filter("name IN ('accepted', 'skipped.duplicate')")
    return counts.select(F.col("batch").cast("int").alias("batch"), "name", "value")


KINDS = ("click", "error", "purchase", "signup", "view")
OUTCOMES = """SELECT 'accepted' AS name, count(*) AS value FROM ev WHERE value >= 5
  UNION ALL SELECT 'accepted.' || signal, count(*) FROM ev WHERE value >= 5 GROUP BY signal
  UNION ALL SELECT 'skipped', count(*) FROM ev WHERE value < 5
  UNION ALL SELECT 'skipped.otlp.invalid_' || name, count(*) FROM ev WHERE value < 5 GROUP BY name
  UNION ALL SELECT 'record.odd_id', count(*) FROM ev WHERE event_id % 7 = 3"""


@query("stream_outcomes", v.EV, sql=OUTCOMES)
def _(spark, d):
    """Accepted, skipped and diagnostic totals of a stream with restarts, from its progress events."""
    base, reasons = scratch(spark), [f"otlp.invalid_{k}" for k in KINDS]
    rows = v.ev_records(spark, d).withColumns({
        "reject_reason": F.when(F.col("value") < 5, F.concat(F.lit("otlp.invalid_"), "name")),
        "diagnostic": F.when(F.col("id").cast("bigint") % 7 == 3, "record.odd_id"),
    })
    listener = OutcomeCounts(spark, f"{base}/totals", reasons, ["record.odd_id"])
    spark.streams.addListener(listener)
    try:
        taken = lambda stream: observe_outcomes(stream, reasons, ["record.odd_id"]).select("project_id", "id")
        arriving(spark, rows, appended(f"{base}/rows", taken))
        listener.settle()
    finally:
        spark.streams.removeListener(listener)
    return stored_outcomes(spark, f"{base}/totals")


DAY, FIRST, LAST = 24 * HOUR, 1704067200000, 1706659200000 + 5_000_000


def rolled_up(spark, d, aggregate: str, first: int, step: int):
    """Samples arrive mixed; the series is read from rollups by day and hour, and from records at the edges."""
    records = v.ev_metrics(spark, d)
    rollups = MetricRollups(spark, scratch(spark), ("event_type", "k"), by_value=aggregate in M.PERCENTILES)
    arriving(spark, records, each_batch(rollups.upsert()))
    request = M.MetricQuery(0, "event.value", aggregate, first, LAST, group_by=("event_type",), interval_ms=step)
    return rollups.series(records, request).withColumn("value", F.round("value", 6))


def rolled_up_sql(value: str, first: int, step: int) -> str:
    return f"""SELECT event_type AS group_0, {first} + (event_ms - {first}) // {step} * {step} AS bucket_ms, round({value}, 6) AS value
  FROM em WHERE event_ms BETWEEN {first} AND {LAST} GROUP BY ALL"""


@query("rollup_percentiles", v.EM, sql=rolled_up_sql("quantile_cont(value, 0.95)", FIRST, DAY))
def _(spark, d):
    return rolled_up(spark, d, "p95", FIRST, DAY)


@query("rollup_average", v.EM, sql=rolled_up_sql("sum(value) / count(*)", FIRST + 90_000, 7 * DAY))
def _(spark, d):
    """Intervals that begin within hours."""
    return rolled_up(spark, d, "avg", FIRST + 90_000, 7 * DAY)
