"""Search, paging, lookup and record-view queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.operators import issues as I
from signaldeck.operators import listing as L
from signaldeck.operators import lookup as J
from signaldeck.operators import search as Q
from signaldeck.plans import views as v
from signaldeck.plans.registry import query, uuid5_sql
from signaldeck.schema import event_ms
from signaldeck.session import shared_folder
from signaldeck.sources import archive as A

DAY1, DAY5, DAY10 = 1704067200000, 1704412800000, 1704844800000
ISSUE_ID = uuid5_sql(ids.ISSUE_NAMESPACE, "fingerprint")


@query("search_eq", v.EV, sql="""SELECT id, level, event_ms FROM ev WHERE project_id = 1 AND level = 'error'""")
def _(spark, d):
    rows = v.ev_records(spark, d).filter((F.col("project_id") == 1) & Q.eq("level", "error"))
    return rows.select("id", "level", event_ms().alias("event_ms"))


@query("search_in_any", v.EV, sql="""SELECT id, name, k FROM ev WHERE name IN ('click', 'view') AND k IN (1, 5, 42)""")
def _(spark, d):
    rows = v.ev_records(spark, d).filter(Q.in_("name", ["click", "view"]) & Q.in_("k", [1, 5, 42, "7"]))
    return rows.select("id", "name", Q.V.as_bigint(Q.variant_field("k")).alias("k"))


@query("search_type_strict", v.EV, sql="""SELECT count(*) FILTER (WHERE user_id = '42') AS as_text,
  CAST(0 AS BIGINT) AS as_number FROM ev""")
def _(spark, d):
    rows = v.ev_records(spark, d)
    return rows.agg(
        F.count_if(Q.eq("user.id", "42")).alias("as_text"),
        F.count_if(Q.eq("user.id", 42)).alias("as_number"),
    )


@query("search_compare", v.EV, sql="""SELECT id, name, value FROM ev
  WHERE value > 100 AND value <= 150.5 AND name >= 'click' AND name < 'signup' AND k >= 50""")
def _(spark, d):
    keep = Q.all_of(
        Q.gt("value", 100), Q.le("value", 150.5), Q.ge("name", "click"), Q.lt("name", "signup"),
        Q.ge("k", 50),
    )
    return v.ev_records(spark, d).filter(keep).select("id", "name", "value")


@query("search_glob_url", sql="""SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, url FROM pages
  WHERE url LIKE 'https://%.example.org/en/%'""")
def _(spark, d):
    rows = v.page_records(spark, d).filter(Q.glob("http.url", "https://*.example.org/en/*"))
    return rows.select("id", Q.V.as_string(Q.variant_field("http.url")).alias("url"))


@query("search_has", v.DL, sql="""SELECT project_id, count(*) FILTER (WHERE level IS NOT NULL) AS with_level,
  count(*) FILTER (WHERE level IS NULL) AS without_level, CAST(0 AS BIGINT) AS with_trace FROM dl GROUP BY project_id""")
def _(spark, d):
    return v.doc_logs(spark, d).groupBy("project_id").agg(
        F.count_if(Q.has("level")).alias("with_level"),
        F.count_if(Q.not_(Q.has("level"))).alias("without_level"),
        F.count_if(Q.has("trace")).alias("with_trace"),
    )


@query("search_text", v.DL, sql="""SELECT id, logger FROM dl WHERE contains(lower(message), lower('The Th'))""")
def _(spark, d):
    return v.doc_logs(spark, d).filter(Q.text("The Th")).select("id", "logger")


@query("search_boolean_not", v.DL, sql="""SELECT id FROM dl WHERE
  NOT coalesce(level = 'info', false) AND (environment = 'en' OR logger LIKE 'w%') """)
def _(spark, d):
    keep = Q.all_of(
        Q.not_(Q.eq("level", "info")), Q.any_of(Q.eq("environment", "en"), Q.glob("logger", "w*"))
    )
    return v.doc_logs(spark, d).filter(keep).select("id")


@query("search_time_range", v.EV, sql=f"""SELECT id, event_ms FROM ev WHERE event_ms BETWEEN {DAY1} AND {DAY5}""")
def _(spark, d):
    rows = v.ev_records(spark, d).filter(Q.time_range(DAY1, DAY5))
    return rows.select("id", event_ms().alias("event_ms"))


def page_sql(limit: int, offset: int = 0) -> str:
    more = f"(SELECT count(*) FROM ({PAGE1})) > {limit + offset}"
    return f"SELECT *, {more} AS has_more FROM ({PAGE1} LIMIT {limit} OFFSET {offset})"


PAGE1 = f"""SELECT id, ts_nano FROM ev WHERE project_id = 1 AND signal = 'log' AND level = 'info'
  AND event_ms BETWEEN {DAY1} AND {DAY10} ORDER BY ts_nano DESC, id DESC"""


@query("page_first", v.EV, sql=page_sql(50))
def _(spark, d):
    rows = Q.search_records(v.ev_records(spark, d), 1, "log", Q.eq("level", "info"), DAY1, DAY10, 50)
    return rows.select("id", "ts_nano", "has_more")


@query("page_second", v.EV, sql=page_sql(50, 50))
def _(spark, d):
    records, keep = v.ev_records(spark, d), Q.eq("level", "info")
    first = Q.search_records(records, 1, "log", keep, DAY1, DAY10, 50).select("id", "ts_nano", "has_more")
    cursor = Q.next_cursor(first.collect())
    rows = Q.search_records(records, 1, "log", keep, DAY1, DAY10, 50, cursor)
    if cursor is None:  # there is no second page
        rows = rows.filter(F.lit(False))
    return rows.select("id", "ts_nano", "has_more")


@query("search_records_tiers", v.EV, sql=page_sql(500))
def _(spark, d):
    records = v.ev_records(spark, d)
    hot = records.filter(F.col("received_at_ms") >= DAY5)
    archive = records.filter(F.col("received_at_ms") < DAY5 + 86_400_000)  # one day overlaps
    rows = Q.search_records(hot, 1, "log", Q.eq("level", "info"), DAY1, DAY10, 500, archive=archive)
    return rows.select("id", "ts_nano", "has_more")


@query("search_issues", v.OE, sql=f"""SELECT title, level, last_seen_ms, total_seen, false AS has_more FROM iss
  WHERE project_id = 1 AND last_seen_ms BETWEEN 0 AND 1000000000000 AND total_seen >= 10
    AND contains(lower(title), 'h') ORDER BY last_seen_ms DESC LIMIT 500""")
def _(spark, d):
    found = I.issues(I.with_issue_id(v.ord_errors(spark, d)))
    keep = Q.all_of(Q.ge("timesSeen", 10), Q.text("H"))
    rows = Q.search_issues(found, 1, keep, 0, 1_000_000_000_000, 500)
    return rows.select("title", "level", "last_seen_ms", "total_seen", "has_more")


@query("read_records_union", v.EV, sql="SELECT project_id, signal, count(*) AS n FROM ev GROUP BY project_id, signal")
def _(spark, d):
    records = v.ev_records(spark, d)
    hot = records.filter(F.col("received_at_ms") >= DAY5)
    archive = records.filter(F.col("received_at_ms") < DAY10)
    both = A.read_records(hot, archive)
    return both.groupBy("project_id", "signal").agg(F.count(F.lit(1)).alias("n"))


@query("read_archive", v.EV, sql=f"""SELECT id, name, value, level FROM ev WHERE project_id = 1 AND signal = 'log'
  AND event_ms BETWEEN {DAY5} AND {DAY10}""")
def _(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/signaldeck-archive-{uuid.uuid4().hex}"
    A.write_archive(v.ev_records(spark, d), path)
    return A.read_archive(spark, path, 1, "log", DAY5, DAY10).select("id", "name", "value", "level")


@query("get_record", v.EV, sql="SELECT id, signal, name, value FROM ev WHERE id = '000000000042'")
def _(spark, d):
    records = v.ev_records(spark, d)
    hot = records.filter(F.col("received_at_ms") >= DAY10)
    project = records.filter(F.col("id") == "000000000042").first()["project_id"]
    found = J.get_record(hot, project, "000000000042", archive=records)
    return found.select("id", "signal", "name", "value")


@query("record_or_issue_record", v.OE, sql="""SELECT 'record' AS kind, CAST(NULL AS VARCHAR) AS issue_id, id AS record_id
  FROM oe WHERE id = '000000000007' AND project_id = (SELECT project_id FROM oe WHERE id = '000000000007')""")
def _(spark, d):
    errors = I.with_issue_id(v.ord_errors(spark, d))
    project = errors.filter(F.col("id") == "000000000007").first()["project_id"]
    return J.record_or_issue(errors, I.issues(errors), project, "000000000007")


@query("record_or_issue_issue", v.OE, sql=f"""SELECT 'issue' AS kind, {ISSUE_ID} AS issue_id,
  latest_record_id AS record_id FROM iss WHERE project_id = 1 AND fingerprint = '3-MEDIUM|F'""")
def _(spark, d):
    errors = I.with_issue_id(v.ord_errors(spark, d))
    key = spark.range(1).select(ids.issue_id(F.lit(None), F.lit("3-MEDIUM|F"))).first()[0]
    return J.record_or_issue(errors, I.issues(errors), 1, key)


# Records lost in this query: two titles, from 2000-01-01 on.
LOST_SQL = "oe.received_at_ms >= 946684800000 AND (oe.title LIKE '%#3' OR oe.title LIKE '%#7')"


@query("issue_latest", v.OE, f"st AS (SELECT * FROM oe WHERE NOT ({LOST_SQL}))", sql="""SELECT i.project_id, i.fingerprint,
    i.latest_record_id, coalesce(l.id, n.id) AS record_id FROM iss i
  LEFT JOIN st l ON l.id = i.latest_record_id AND l.project_id = i.project_id
  LEFT JOIN (SELECT project_id, fingerprint, arg_max(id, struct_pack(ts_nano, id)) AS id FROM st GROUP BY ALL) n
    ON n.project_id = i.project_id AND n.fingerprint = i.fingerprint""")
def _(spark, d):
    errors = I.with_issue_id(v.ord_errors(spark, d))
    title = F.col("issue_title")
    lost = (F.col("received_at_ms") >= 946684800000) & (title.endswith("#3") | title.endswith("#7"))
    prints = errors.select("project_id", "issue_id", F.col("issue_fingerprint").alias("fingerprint")).distinct()
    rows = J.issue_latest(I.issues(errors), errors.filter(~lost))
    return rows.join(prints, ["project_id", "issue_id"]).select(
        "project_id", "fingerprint", "latest_record_id", "record_id"
    )


@query("issue_events", v.OE, sql="""SELECT oe.project_id, oe.id FROM oe JOIN iss
  ON oe.project_id = iss.project_id AND oe.fingerprint = iss.fingerprint
  AND oe.event_ms BETWEEN iss.first_seen_ms AND iss.last_seen_ms
  WHERE iss.level = 'fatal'""")
def _(spark, d):
    errors = I.with_issue_id(v.ord_errors(spark, d))
    wanted = I.issues(errors).filter(F.col("level") == "fatal")
    return J.issue_events(wanted, errors).select("project_id", "id")


@query("errors_to_spans", sql="""SELECT lpad(CAST(e.event_id AS VARCHAR), 12, '0') || '-error' AS error_id,
  lpad(CAST(e.event_id AS VARCHAR), 12, '0') AS source_record_id, 'Boom: ' || e.event_type AS error_title,
  e.event_type AS source_name FROM events e WHERE e.event_type = 'error'""")
def _(spark, d):
    spans = v.ev_records(spark, d).withColumn("signal", F.lit("trace"))
    errors = spans.filter(F.col("name") == "error").withColumns({
        "source_record_id": F.col("id"),
        "id": F.concat("id", F.lit("-error")),
        "title": F.concat(F.lit("Boom: "), F.col("name")),
    })
    return J.errors_to_spans(errors, spans).select("error_id", "source_record_id", "error_title", "source_name")


@query("active_only", sql="""SELECT e.user_id % 10 AS project_id, count(*) AS n FROM events e
  WHERE e.user_id % 10 IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) GROUP BY ALL""")
def _(spark, d):
    records = v.table(spark, d, "events").select((F.col("user_id") % 10).alias("project_id"))
    projects = v.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("project_id"),
        F.when(F.col("n_regionkey") == 1, "deleting").otherwise("active").alias("status"),
    )
    return J.active_only(records, projects).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("new_only", v.DL, sql="""SELECT id FROM dl WHERE received_at_ms >= 400000 AND NOT EXISTS
  (SELECT 1 FROM dl s WHERE s.received_at_ms < 400000 AND s.project_id = dl.project_id AND s.source_id = dl.source_id)""")
def _(spark, d):
    logs = v.doc_logs(spark, d)
    stored = F.col("received_at_ms") < 400_000
    return J.new_only(logs.filter(~stored), logs.filter(stored)).select("id")


@query("trace_spans", sql="""SELECT lpad(CAST(l_orderkey AS VARCHAR), 32, '0') AS trace_id, l_linenumber AS span,
  CAST(l_quantity AS BIGINT) AS duration FROM lineitem WHERE l_orderkey = 7""")
def _(spark, d):
    spans = v.table(spark, d, "lineitem").select(
        F.lit(1).cast("bigint").alias("project_id"), F.lit("trace").alias("signal"),
        F.lpad(F.col("l_orderkey").cast("string"), 32, "0").alias("trace_id"),
        F.col("l_linenumber").alias("span"), F.col("l_quantity").cast("bigint").alias("duration"),
    )
    return J.trace_spans(spans, 1, "7".rjust(32, "0")).select("trace_id", "span", "duration")


def duration_sql(ns: str) -> str:
    def scaled(step: int, base: int, unit: str) -> str:
        steps = f"(({ns} + {step // 2}) // {step})"
        width = len(str(base)) - 1
        return (
            f"CAST({steps} // {base} AS VARCHAR) || '.' || "
            f"lpad(CAST({steps} % {base} AS VARCHAR), {width}, '0') || ' {unit}'"
        )

    return (
        f"CASE WHEN {ns} < 1000 THEN CAST({ns} AS VARCHAR) || ' ns' "
        f"WHEN {ns} < 1000000 THEN {scaled(100, 10, 'us')} "
        f"WHEN {ns} < 1000000000 THEN {scaled(100000, 10, 'ms')} "
        f"ELSE {scaled(10000000, 100, 's')} END"
    )


@query("listing", v.EV, sql=f"""SELECT id, name AS text, level, 'otlp' AS origin, 'unset' AS status,
  {duration_sql('(event_id * event_id * 37)')} AS duration FROM ev""")
def _(spark, d):
    n = F.col("id").cast("bigint")
    rows = v.ev_records(spark, d).withColumn("duration_ns", n * n * 37)
    return L.listing(rows).select("id", "text", "level", "origin", "status", "duration")


@query("record_view", v.EV, sql="""SELECT id, '{"attribute.k":' || CAST(k AS VARCHAR) || ',"id":"' || id || '","level":"' || level ||
  '","name":"' || name || '","project.id":' || CAST(project_id AS VARCHAR) || ',"received":' || CAST(received_at_ms AS VARCHAR) ||
  ',"signal":"' || signal || '","source":"otlp","source_id":"' || source_id || '","timestamp":' || CAST(ts_nano AS VARCHAR) ||
  ',"user.id":"' || user_id || '"}' AS fields FROM ev""")
def _(spark, d):
    rows = v.ev_records(spark, d).withColumn("value", F.lit(None).cast("double"))
    return L.record_view(rows).select("id", F.to_json("fields").alias("fields"))


@query("prefixed_fields", v.EV, sql="""SELECT id, 'id' AS key, user_id AS value FROM ev""")
def _(spark, d):
    return L.prefixed_fields(v.ev_records(spark, d), "user.").select(
        "id", "key", Q.V.as_string(F.col("value")).alias("value")
    )


@query("truncate_raw", sql="""SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS id,
  octet_length(encode(html)) > 4096 AS raw_truncated,
  CASE WHEN octet_length(encode(html)) <= 4096 THEN md5(html) ELSE NULL END AS whole_md5,
  octet_length(encode(html)) <= 4096 OR starts_with(html, html[1:1000]) AS is_prefix FROM pages""")
def _(spark, d):
    rows = v.page_records(spark, d)
    size, full = F.octet_length("raw"), F.col("_full")
    cut = L.truncate_raw(rows.withColumn("_full", F.col("raw")), 4096)
    prefix = full.startswith(F.col("raw")) & (size <= 4096) & (~F.col("raw_truncated") | (size > 4092))
    return cut.select(
        "id", "raw_truncated", F.when(~F.col("raw_truncated"), F.md5("raw")).alias("whole_md5"),
        prefix.alias("is_prefix"),
    )


FRAMES = """fr AS (SELECT page_id, unnest(string_split(html, '<')) AS frame,
    generate_subscripts(string_split(html, '<'), 1) AS pos FROM pages),
  fb AS (SELECT *, contains(frame, '>') AND starts_with(frame, 'p') AS in_app FROM fr),
  fg AS (SELECT *, CASE WHEN in_app OR coalesce(lag(in_app) OVER (PARTITION BY page_id ORDER BY pos), true) THEN 1 ELSE 0 END AS brk FROM fb),
  fs AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY pos) AS g FROM fg)"""


@query("collapse_frames", FRAMES, sql="""SELECT page_id, CAST(g AS BIGINT) AS group_no, bool_or(in_app) AS in_app,
  count(*) AS frames, min(pos) - 1 AS first_frame FROM fs GROUP BY page_id, g""")
def _(spark, d):
    parts = F.transform(
        F.split("html", "<", -1),
        lambda text, i: F.struct(i.alias("pos"), (text.contains(">") & text.startswith("p")).alias("in_app")),
    )
    rows = v.spread(v.table(spark, d, "pages")).select("page_id", parts.alias("frames"))
    rows = L.collapse_frames(rows, "frames", "groups")
    return rows.select("page_id", F.posexplode("groups")).select(
        "page_id", (F.col("pos") + 1).cast("bigint").alias("group_no"), F.col("col.in_app").alias("in_app"),
        F.size("col.frames").cast("bigint").alias("frames"),
        F.col("col.frames")[0]["pos"].cast("bigint").alias("first_frame"),
    )
