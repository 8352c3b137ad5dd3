"""Queries over the archive with a commit log: writes, lookups, pages, compaction, eviction."""

from __future__ import annotations

from pyspark.sql import functions as F

from signaldeck.operators import lookup as J
from signaldeck.plans import views as v
from signaldeck.plans.registry import query
from signaldeck.plans.state_queries import CUTOFF
from signaldeck.plans.trace_queries import LS, li_spans
from signaldeck.schema import conform
from signaldeck.session import LineageCut
from signaldeck.sources.snapshots import Archive


def new_archive(spark) -> Archive:
    return Archive(spark, LineageCut(spark).new_path())


@query("archive_trace_lookup", LS, sql="""SELECT trace_id, id, ts AS ts_nano FROM ls
  WHERE trace_id = (SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem)""")
def _(spark, d):
    """Order lines archived in three commits; one order is found by the key index."""
    spans = li_spans(spark, d).withColumn("signal", F.lit("trace"))
    archive, order = new_archive(spark), F.col("trace_id").cast("bigint")
    spans = conform(spans.withColumn("received_at_ms", order % 4 * 86_400_000))
    for part in range(3):
        archive.append(spans.where(order % 3 == part))
    newest = v.table(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return J.trace_spans(archive, 1, str(newest)).select("trace_id", "id", "ts_nano")


@query("archive_record_lookup", v.EV, sql="SELECT project_id, id, signal, ts_nano, value FROM ev WHERE id = lpad('77', 12, '0')")
def _(spark, d):
    archive = new_archive(spark)
    for part in range(2):
        archive.append(v.ev_records(spark, d).where(F.col("project_id") % 2 == part))
    none = v.ev_records(spark, d).where("false")
    found = [J.get_record(none, project, "77".rjust(12, "0"), archive) for project in range(3)]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("project_id", "id", "signal", "ts_nano", "value")


@query("archive_newest_page", v.EV, sql="""SELECT id, ts_nano, true AS has_more FROM ev
  WHERE project_id = 0 AND signal = 'log' AND level = 'debug' ORDER BY ts_nano DESC, id DESC LIMIT 50""")
def _(spark, d):
    """A page over an archive by weeks; files are read from the newest on until it is full."""
    archive, records = new_archive(spark), v.ev_records(spark, d)
    week = F.call_function("div", F.col("received_at_ms"), F.lit(7 * 86_400_000)) % 4
    for part in range(4):
        archive.append(records.where(week == part))
    return archive.newest_page(0, "log", F.col("level") == "debug", 50).select("id", "ts_nano", "has_more")


@query("archive_compact", v.EV, sql=f"""SELECT CASE WHEN received_at_ms < {CUTOFF} THEN 'archive' ELSE 'hot' END AS tier,
  project_id, signal, count(*) AS n, min(ts_nano) AS first, max(received_at_ms) AS newest, CAST(sum(octet_length(encode(id))) AS BIGINT) AS chars FROM ev GROUP BY ALL""")
def _(spark, d):
    """Hot records compacted twice, the second time with rows that are archived already; both tiers read back."""
    archive, records = new_archive(spark), v.ev_records(spark, d)
    archive.compact(records, CUTOFF - 3 * 86_400_000)
    archive.compact(records, CUTOFF)
    both = archive.read().withColumn("tier", F.lit("archive")).unionByName(archive.hot().withColumn("tier", F.lit("hot")))
    return both.groupBy("tier", "project_id", "signal").agg(
        F.count("*").alias("n"), F.min("ts_nano").alias("first"), F.max("received_at_ms").alias("newest"), F.sum(F.length("id")).alias("chars")
    )


EVD = """evd AS (SELECT *, make_date(CAST(received_at_ms // 86400000 AS INTEGER)) AS day FROM ev)"""


@query("archive_evict_merge", v.EV, EVD, sql="""SELECT project_id, signal, count(*) AS n, min(received_at_ms) AS oldest, CAST(count(DISTINCT day) AS BIGINT) AS days
  FROM evd WHERE signal = 'error' AND NOT (day < (SELECT min(day) + 5 FROM evd)) GROUP BY ALL""")
def _(spark, d):
    """Error records in three commits, the oldest days evicted, small files merged: what the log says is left."""
    archive, records = new_archive(spark), v.ev_records(spark, d).where("signal = 'error'")
    for part in range(3):
        archive.append(records.where(F.col("value").cast("bigint") % 3 == part))
    parts = archive.manifest()
    first = parts.agg(F.min("receive_date")).first()[0]
    archive.drop(parts.where(F.col("receive_date") < F.date_add(F.lit(first), 5)))
    archive.merge_small(1_000_000)
    left = archive.files().groupBy("project_id", "signal").agg(
        F.sum("records").alias("n"), F.min("min_received_ms").alias("oldest"), F.countDistinct("receive_date").alias("days")
    )
    read = archive.read().groupBy("project_id", "signal").agg(F.count("*").alias("read"))
    return left.join(read, ["project_id", "signal"]).where("n = read").drop("read")
