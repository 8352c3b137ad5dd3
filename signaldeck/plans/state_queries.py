"""Issue, counter, de-duplication and retention queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.functions import scalars as S
from signaldeck.operators import issues as I
from signaldeck.operators import ordered as O
from signaldeck.operators import retention as R
from signaldeck.plans import views as v
from signaldeck.plans.registry import query, uuid5_sql
from signaldeck.schema import event_ms

ISSUE_ID = uuid5_sql(ids.ISSUE_NAMESPACE, "fingerprint")


def errors_of(spark, d):
    return I.with_issue_id(v.ord_errors(spark, d))


@query("issue_id", v.OE, sql=f"SELECT id, {ISSUE_ID} AS issue_id FROM oe")
def _(spark, d):
    return errors_of(spark, d).select("id", "issue_id")


@query("issues", v.OE, sql=f"""SELECT project_id, {ISSUE_ID} AS issue_id, title, level, first_seen_ms, last_seen_ms,
  total_seen, total_seen AS retained_events, latest_record_id FROM iss""")
def _(spark, d):
    return I.issues(errors_of(spark, d))


@query("issues_merged", v.OE, sql=f"""SELECT project_id, {ISSUE_ID} AS issue_id, title, level, first_seen_ms,
  last_seen_ms, total_seen, latest_record_id FROM iss""")
def _(spark, d):
    errors = errors_of(spark, d)
    # Three arrival batches: before 1996, before 1999, later.
    bounds = [0, 820454400000, 915148800000, 2**62]
    arrived = F.col("received_at_ms")
    parts = [I.issue_state(errors.filter((arrived >= a) & (arrived < b))) for a, b in zip(bounds, bounds[1:])]
    return I.issue_rows(I.merge_issue_state(*parts)).drop("retained_events")


@query("issues_retained", v.OE, sql=f"""SELECT project_id, {ISSUE_ID} AS issue_id, total_seen,
  (SELECT count(*) FROM oe WHERE oe.project_id = iss.project_id AND oe.fingerprint = iss.fingerprint
     AND oe.received_at_ms >= 883612800000 AND oe.title NOT LIKE '%#3') AS retained_events,
  CASE WHEN latest_record_id IN (SELECT id FROM oe WHERE oe.received_at_ms >= 883612800000 AND oe.title NOT LIKE '%#3') THEN latest_record_id END AS latest_record_id
  FROM iss""")
def _(spark, d):
    errors = errors_of(spark, d)
    # Evicted: everything received before 1998, and one title.
    kept = errors.filter((F.col("received_at_ms") >= 883612800000) & ~F.col("issue_title").endswith("#3"))
    return I.retained(I.issues(errors), kept).select(
        "project_id", "issue_id", "total_seen", "retained_events", "latest_record_id"
    )


@query("difference_cumulative", v.CT, sql="""SELECT project_id, id, stream_id, CAST(reading AS DOUBLE) AS cumulative_value,
  CAST(delta AS DOUBLE) AS value, violation FROM df""")
def _(spark, d):
    rows = O.difference_cumulative(v.ev_counter(spark, d))
    return rows.select("project_id", "id", "stream_id", "cumulative_value", "value", "violation")


@query("difference_cumulative_slices", v.CT, sql="""SELECT project_id, id, CAST(delta AS DOUBLE) AS value, violation FROM df""")
def _(spark, d):
    rows = O.difference_cumulative(v.ev_counter(spark, d), parts=12)
    return rows.select("project_id", "id", "value", "violation")


@query("monotonic_violations", v.CT, sql="SELECT project_id, count(*) AS violations FROM df WHERE violation GROUP BY project_id")
def _(spark, d):
    return O.monotonic_violations(O.difference_cumulative(v.ev_counter(spark, d)))


@query("dedupe", v.DL, sql="""SELECT id, source_id FROM (SELECT *, row_number() OVER (
  PARTITION BY project_id, source_id ORDER BY received_at_ms, ts_nano, id) AS rn FROM dl WHERE doc_id % 10 <> 0) WHERE rn = 1
  UNION ALL SELECT id, NULL FROM dl WHERE doc_id % 10 = 0""")
def _(spark, d):
    logs = v.doc_logs(spark, d)
    none = F.col("id").endswith("0")
    return O.dedupe(logs.withColumn("source_id", F.when(~none, F.col("source_id")))).select("id", "source_id")


EVS = """evs AS (SELECT project_id, signal, id, received_at_ms, event_ms, size,
    CAST(make_date(CAST(received_at_ms // 86400000 AS INTEGER)) AS VARCHAR) AS receive_date FROM ev)"""
MAN = """man AS (SELECT project_id, signal, receive_date, count(*) AS records, min(event_ms) AS min_event_ms,
    max(event_ms) AS max_event_ms, min(received_at_ms) AS min_received_ms, max(received_at_ms) AS max_received_ms,
    CAST(sum(size) AS BIGINT) AS logical_bytes FROM evs GROUP BY ALL)"""


def sized(spark, d):
    return v.ev_records(spark, d).withColumn("size", F.octet_length("raw").cast("bigint"))


def ev_manifest(spark, d):
    return R.manifest(sized(spark, d), "size")


@query("manifest", v.EV, EVS, MAN, sql="SELECT * FROM man")
def _(spark, d):
    return ev_manifest(spark, d).withColumn("receive_date", F.col("receive_date").cast("string"))


TARGET = "(SELECT sum(logical_bytes) * 2 // 3 FROM man)"
PLAN = f"""pl AS (SELECT * FROM (SELECT *, sum(logical_bytes) OVER () AS total, coalesce(sum(logical_bytes) OVER (
    ORDER BY min_received_ms, project_id, signal, receive_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM man) WHERE total - prior > {TARGET})"""


def two_thirds(df, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] * 2 // 3


@query("evict_plan", v.EV, EVS, MAN, PLAN, sql="""SELECT project_id, signal, receive_date, logical_bytes FROM pl""")
def _(spark, d):
    parts = ev_manifest(spark, d)
    plan = O.evict_plan(parts, two_thirds(parts, "logical_bytes"))
    return plan.select("project_id", "signal", F.col("receive_date").cast("string").alias("receive_date"), "logical_bytes")


@query("apply_eviction", v.EV, EVS, MAN, PLAN, sql="""SELECT project_id, signal, id FROM evs
  WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.project_id = evs.project_id AND pl.signal = evs.signal
    AND pl.receive_date = evs.receive_date)""")
def _(spark, d):
    records = sized(spark, d)
    parts = R.manifest(records, "size")
    plan = O.evict_plan(parts, two_thirds(parts, "logical_bytes"))
    return R.apply_eviction(records, plan).select("project_id", "signal", "id")


@query("evict_hot", v.EV, EVS, sql="""SELECT project_id, id FROM (SELECT *, sum(size) OVER () AS total,
    coalesce(sum(size) OVER (ORDER BY received_at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM evs) WHERE total - prior > (SELECT sum(size) * 2 // 3 FROM evs)""")
def _(spark, d):
    records = sized(spark, d)
    return O.evict_hot(records, two_thirds(records, "size"), size="size").select("project_id", "id")


@query("evict_issues", v.OE, sql=f"""SELECT project_id, issue_id FROM (SELECT *, sum(size) OVER () AS total,
    coalesce(sum(size) OVER (ORDER BY first_seen_ms, issue_id, project_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM (SELECT project_id, first_seen_ms, {ISSUE_ID} AS issue_id, 100 + length(title) AS size FROM iss))
  WHERE total - prior > 3000""")
def _(spark, d):
    table = I.issues(errors_of(spark, d)).withColumn("size", (F.length("title") + 100).cast("bigint"))
    return O.evict_issues(table, 3000, size="size").select("project_id", "issue_id")


CUTOFF = 1705276800000


@query("compact_split", v.EV, sql=f"""SELECT CASE WHEN received_at_ms < {CUTOFF} THEN 'archive' ELSE 'hot' END AS tier,
  signal, count(*) AS n, max(received_at_ms) AS newest FROM ev GROUP BY ALL""")
def _(spark, d):
    old, recent = R.split_by_arrival(v.ev_records(spark, d), CUTOFF)
    both = old.withColumn("tier", F.lit("archive")).unionByName(recent.withColumn("tier", F.lit("hot")))
    return both.groupBy("tier", "signal").agg(
        F.count(F.lit(1)).alias("n"), F.max("received_at_ms").alias("newest")
    )


@query("delete_project", v.EV, sql="SELECT project_id, count(*) AS n FROM ev WHERE project_id <> 1 GROUP BY project_id")
def _(spark, d):
    return R.delete_project(v.ev_records(spark, d), 1).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("storage_status", v.EV, EVS, MAN, sql="""SELECT CAST(sum(records) AS BIGINT) AS records,
  CAST(sum(logical_bytes) AS BIGINT) AS logical_bytes, sum(logical_bytes) >= 100000 * 4 // 5 AS storage_warning FROM man""")
def _(spark, d):
    records = sized(spark, d)
    old, hot = R.split_by_arrival(records, CUTOFF)
    return R.storage_status(R.manifest(old, "size"), 100_000, hot, size="size")


@query("counters", v.EV, v.CT, sql="""SELECT 'accepted' AS name, count(*) AS value FROM ev WHERE value >= 5
  UNION ALL SELECT 'accepted.' || signal, count(*) FROM ev WHERE value >= 5 GROUP BY signal
  UNION ALL SELECT 'skipped', count(*) FROM ev WHERE value < 5
  UNION ALL SELECT 'skipped.otlp.invalid_' || name, count(*) FROM ev WHERE value < 5 GROUP BY name
  UNION ALL SELECT 'metric.cumulative_sum_monotonic_decrease', count(*) FROM df WHERE violation""")
def _(spark, d):
    records = v.ev_records(spark, d)
    rejected = records.filter(F.col("value") < 5).select(F.concat(F.lit("otlp.invalid_"), "name").alias("reason"))
    decreases = O.difference_cumulative(v.ev_counter(spark, d)).filter("violation").select(
        F.lit("metric.cumulative_sum_monotonic_decrease").alias("name")
    )
    return R.counters(records.filter(F.col("value") >= 5), rejected, decreases)


@query("logical_bytes", v.OE, sql="""SELECT id, octet_length(encode('{"id":"' || id || '","issue_title":"' || title || '","level":"' || level || '"}')) AS bytes
  FROM oe""")
def _(spark, d):
    return v.ord_errors(spark, d).select(
        "id", S.logical_bytes(F.col("id"), F.col("issue_title"), F.coalesce("level", F.lit("error")).alias("level")).alias("bytes")
    )


@query("receive_date", v.EV, sql="""SELECT CAST(make_date(CAST(received_at_ms // 86400000 AS INTEGER)) AS VARCHAR) AS date,
  count(*) AS n, min(event_ms) AS first_ms FROM ev GROUP BY ALL""")
def _(spark, d):
    day = S.receive_date(F.col("received_at_ms")).cast("string").alias("date")
    return v.ev_records(spark, d).groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.min(event_ms()).alias("first_ms")
    )


OLD = f"old AS (SELECT * FROM evs WHERE received_at_ms < {CUTOFF})"
HOT = f"""hot AS (SELECT *, CAST(sum(size) OVER () AS BIGINT) AS total, coalesce(sum(size) OVER (ORDER BY received_at_ms, id, project_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM evs WHERE received_at_ms >= {CUTOFF})"""


@query("enforce_target", v.EV, EVS, OLD, HOT, sql="""SELECT 'archive' AS tier,
    count(DISTINCT (project_id, signal, receive_date)) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM old
  UNION ALL SELECT 'hot', count(*), CAST(sum(size) AS BIGINT) FROM hot WHERE total - prior > total // 2
  UNION ALL SELECT 'issues', 0, NULL""")
def _(spark, d):
    """A target of half the hot records beside all issues: the whole archive goes, then the oldest hot records."""
    old, hot = R.split_by_arrival(sized(spark, d), CUTOFF)
    issues = I.issues(errors_of(spark, d)).withColumn("size", (F.length("title") + 100).cast("bigint"))
    target = hot.agg(F.sum("size")).first()[0] // 2 + issues.agg(F.sum("size")).first()[0]
    plan, dropped, gone = R.enforce_target(R.manifest(old, "size"), hot, issues, target, "size")
    tiers = [(plan, "archive", "logical_bytes"), (dropped, "hot", "size"), (gone, "issues", "size")]
    parts = [df.agg(F.lit(t).alias("tier"), F.count("*").alias("n"), F.sum(c).alias("bytes")) for df, t, c in tiers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
