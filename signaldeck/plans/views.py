"""The driver tables seen as telemetry.

Each view has a Spark form (a DataFrame in record columns) and a SQL form (a CTE for
the oracle) with the same formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions import variants as V
from signaldeck.schema import conform, int_div


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A file may hold all its rows in one row group of this size, however many splits are planned.
ROW_GROUP = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of fewer row groups than cores: row groups, not splits, are dealt to tasks.

    A table large enough for the cluster stays as it is; others are dealt out in up to four tasks a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(min(4 * cores, max(cores, size >> 16))) if size < cores * ROW_GROUP else df


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def ev_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as mixed records."""
    kind = F.col("event_type")
    us = epoch_micros(F.col("ts"))
    fields = V.field_map(
        ("attribute.k", V.of(F.get_json_object("props", "$.k").cast("bigint"))),
        ("user.id", V.of(F.col("user_id").cast("string"))),
    )
    return conform(
        table(spark, sf_dir, "events").select(
            (F.col("user_id") % 3).alias("project_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
            F.when(kind == "error", "error").when(kind == "purchase", "metric")
            .when(kind == "signup", "trace").otherwise("log").alias("signal"),
            F.lit("otlp").alias("source"),
            F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("source_id"),
            (us * 1_000).alias("ts_nano"),
            (int_div(us, 1_000) + (F.col("event_id") * 7919) % 600_000).alias("received_at_ms"),
            F.when(kind == "error", "error").when(kind == "view", "debug").otherwise("info").alias("level"),
            kind.alias("name"),
            F.col("value"),
            F.to_variant_object(fields).alias("fields"),
            F.col("props").alias("raw"),
        )
    )


EV = """ev AS (
  SELECT user_id % 3 AS project_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'metric'
      WHEN 'signup' THEN 'trace' ELSE 'log' END AS signal,
    's' || CAST(event_id AS VARCHAR) AS source_id,
    epoch_us(ts) * 1000 AS ts_nano, epoch_us(ts) // 1000 AS event_ms,
    epoch_us(ts) // 1000 + (event_id * 7919) % 600000 AS received_at_ms,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
    event_type AS name, value, CAST(user_id AS VARCHAR) AS user_id, user_id AS user_no,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, octet_length(CAST(props AS BLOB)) AS size
  FROM events)"""


def ev_metrics(spark: SparkSession, sf_dir: str, metric_type: str = "distribution") -> DataFrame:
    """events as samples of one metric of project 0, event type as an attribute."""
    fields = V.field_map(
        ("attribute.event_type", V.of(F.col("event_type"))),
        ("attribute.k", V.of(F.get_json_object("props", "$.k").cast("bigint"))),
    )
    us = epoch_micros(F.col("ts"))
    return conform(
        table(spark, sf_dir, "events").select(
            F.lit(0).cast("bigint").alias("project_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
            F.lit("metric").alias("signal"),
            F.lit("otlp").alias("source"),
            (us * 1_000).alias("ts_nano"),
            int_div(us, 1_000).alias("received_at_ms"),
            F.lit("event.value").alias("name"),
            F.lit(metric_type).alias("type"),
            F.col("value"),
            F.to_variant_object(fields).alias("fields"),
        )
    )


EM = """em AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, epoch_us(ts) // 1000 AS event_ms,
    epoch_us(ts) * 1000 AS ts_nano, event_type, value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

DAY_NS = 86_400_000_000_000


def ev_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as readings of cumulative counters that restart every UTC day."""
    us = epoch_micros(F.col("ts"))
    return conform(
        table(spark, sf_dir, "events").select(
            (F.col("user_id") % 3).alias("project_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
            F.lit("metric").alias("signal"),
            F.lit("otlp").alias("source"),
            (us * 1_000).alias("ts_nano"),
            int_div(us, 1_000).alias("received_at_ms"),
            F.lit("event.counter").alias("name"),
            F.lit("sum").alias("type"),
            F.lit("cumulative").alias("temporality"),
            F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("stream_id"),
            (F.col("user_id") % 2 == 0).alias("monotonic"),
            F.round(F.col("value") * 100).cast("bigint").cast("double").alias("value"),
            (int_div(us, 86_400_000_000) * DAY_NS).alias("start_nano"),
        )
    )


# Readings with run (same start) and the last accepted value before each reading.
CT = """ct0 AS (
  SELECT user_id % 3 AS project_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    CAST(user_id AS VARCHAR) || event_type AS stream_id, user_id % 2 = 0 AS monotonic,
    epoch_us(ts) AS us, epoch_us(ts) // 86400000000 AS day, CAST(round(value * 100) AS BIGINT) AS v
  FROM events),
ct AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, stream_id ORDER BY us, id) AS rn,
    CASE WHEN monotonic
      THEN max(v) OVER (PARTITION BY project_id, stream_id, day ORDER BY us, id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      ELSE lag(v) OVER (PARTITION BY project_id, stream_id, day ORDER BY us, id) END AS prev
  FROM ct0),
df AS (
  SELECT project_id, id, stream_id, v AS reading,
    coalesce(monotonic AND v < prev, false) AS violation,
    CASE WHEN rn = 1 THEN NULL WHEN prev IS NULL THEN v
      WHEN monotonic AND v < prev THEN NULL ELSE v - prev END AS delta
  FROM ct)"""


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as logs; equal texts share a source id."""
    n = F.col("doc_id")
    return conform(
        table(spark, sf_dir, "documents").select(
            (n % 5).alias("project_id"),
            F.lpad(n.cast("string"), 12, "0").alias("id"),
            F.lit("log").alias("signal"),
            F.lit("otlp").alias("source"),
            F.md5("text").alias("source_id"),
            ((n + 1) * 1_000_000_000).alias("ts_nano"),
            (n * 1_000 + (n * 7919) % 600_000).alias("received_at_ms"),
            F.col("text").alias("message"),
            F.col("source").alias("logger"),
            F.col("lang").alias("environment"),
            F.when(n % 2 == 0, "info").alias("level"),
        )
    )


DL = """dl AS (
  SELECT doc_id % 5 AS project_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, md5(text) AS source_id,
    (doc_id + 1) * 1000 AS event_ms, (doc_id + 1) * 1000000000 AS ts_nano,
    doc_id * 1000 + (doc_id * 7919) % 600000 AS received_at_ms,
    text AS message, source AS logger, lang AS environment,
    CASE WHEN doc_id % 2 = 0 THEN 'info' END AS level, doc_id
  FROM documents)"""


def ord_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as errors; priority and status make the fingerprint."""
    us = epoch_micros(F.col("o_orderdate"))
    return conform(
        table(spark, sf_dir, "orders").select(
            (F.col("o_custkey") % 3).alias("project_id"),
            F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"),
            F.lit("error").alias("signal"),
            F.lit("sentry").alias("source"),
            (us * 1_000).alias("ts_nano"),
            (int_div(us, 1_000) + F.col("o_orderkey") % 86_400_000).alias("received_at_ms"),
            F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("issue_fingerprint"),
            F.concat(F.col("o_orderpriority"), F.lit(" #"), (F.col("o_orderkey") % 10).cast("string")).alias("issue_title"),
            F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderkey") % 4 == 1, "fatal").otherwise("error")).alias("level"),
        )
    )


OE = """oe AS (
  SELECT o_custkey % 3 AS project_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id,
    epoch_us(o_orderdate) * 1000 AS ts_nano, epoch_us(o_orderdate) // 1000 AS event_ms,
    epoch_us(o_orderdate) // 1000 + o_orderkey % 86400000 AS received_at_ms,
    o_orderpriority || '|' || o_orderstatus AS fingerprint,
    o_orderpriority || ' #' || CAST(o_orderkey % 10 AS VARCHAR) AS title,
    CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'fatal' ELSE 'error' END AS level
  FROM orders),
iss AS (
  SELECT project_id, fingerprint, arg_max(title, struct_pack(ts_nano, id)) AS title,
    arg_min(level, struct_pack(ts_nano, id)) AS level, min(event_ms) AS first_seen_ms,
    max(event_ms) AS last_seen_ms, count(*) AS total_seen, arg_max(id, struct_pack(ts_nano, id)) AS latest_record_id
  FROM oe GROUP BY project_id, fingerprint)"""


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as trace records with a URL; the HTML is the raw text."""
    n = F.col("page_id")
    fields = V.field_map(("http.url", V.of(F.col("url"))), ("attribute.page", V.of(n)))
    return conform(
        table(spark, sf_dir, "pages").select(
            F.lit(1).cast("bigint").alias("project_id"),
            F.lpad(n.cast("string"), 12, "0").alias("id"),
            F.lit("trace").alias("signal"),
            F.lit("ddtrace").alias("source"),
            (n * 1_000_000).alias("ts_nano"),
            n.alias("received_at_ms"),
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("name"),
            (n * n * n * 37).alias("duration_ns"),
            F.to_variant_object(fields).alias("fields"),
            F.col("html").alias("raw"),
        )
    )
