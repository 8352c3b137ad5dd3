"""Key lookups in set form: records, issues, traces and project membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.operators.search import LONG_MAX, time_range
from signaldeck.schema import event_ms
from signaldeck.sources.snapshots import Archive

ISSUE = ["project_id", "issue_id"]


def get_record(records: DataFrame, project_id: int, record_id: str,
               archive: DataFrame | Archive | None = None) -> DataFrame:
    """One record by id, from the hot table before the archive.

    An :class:`Archive` is asked through its key index, which names the files to read.
    """
    if isinstance(archive, Archive):
        archive = archive.lookup("id", record_id, project_id)
    key = (F.col("project_id") == project_id) & (F.col("id") == record_id)
    found = records.filter(key)
    if archive is None:
        return found.limit(1)
    both = found.withColumn("_tier", F.lit(0)).unionByName(
        archive.filter(key).withColumn("_tier", F.lit(1)), allowMissingColumns=True
    )
    return both.orderBy("_tier").limit(1).drop("_tier")


def issue_latest(issues: DataFrame, records: DataFrame) -> DataFrame:
    """Issue -> its latest record; if evicted, its newest stored one; else NULL.

    Adds ``record_id`` and ``record_ts_nano``.
    """
    errors = records.filter(F.col("issue_id").isNotNull())
    latest_key = issues.filter(F.col("latest_record_id").isNotNull()).select(
        *ISSUE, F.col("latest_record_id").alias("id")
    )
    latest = errors.select(*ISSUE, "id", "ts_nano").join(latest_key, [*ISSUE, "id"]).select(
        *ISSUE, F.struct("ts_nano", "id").alias("_latest")
    )
    newest = errors.groupBy(*ISSUE).agg(F.max(F.struct("ts_nano", "id")).alias("_newest"))
    chosen = F.coalesce("_latest", "_newest")
    return (
        issues.join(latest, ISSUE, "left")
        .join(newest, ISSUE, "left")
        .select(
            *issues.columns,
            chosen["id"].alias("record_id"),
            chosen["ts_nano"].alias("record_ts_nano"),
        )
    )


def record_or_issue(records: DataFrame, issues: DataFrame, project_id: int, key: str) -> DataFrame:
    """Resolve an id to a record, else to an issue with its latest record.

    Columns: kind ('record' or 'issue'), the issue id (issues only) and the record id.
    """
    as_record = get_record(records, project_id, key).select(
        F.lit("record").alias("kind"), F.lit(None).cast("string").alias("issue_id"),
        F.col("id").alias("record_id"),
    )
    mine = issues.filter((F.col("project_id") == project_id) & (F.col("issue_id") == key))
    of_issue = records.filter((F.col("project_id") == project_id) & (F.col("issue_id") == key))
    as_issue = issue_latest(mine, of_issue).select(
        F.lit("issue").alias("kind"), "issue_id", "record_id"
    )
    return as_record.unionByName(as_issue).orderBy(F.col("kind").desc()).limit(1)


def issue_events(issues: DataFrame, records: DataFrame) -> DataFrame:
    """Stored records of the given issues between first and last seen."""
    span = issues.select(*ISSUE, "first_seen_ms", "last_seen_ms")
    return (
        records.filter(F.col("issue_id").isNotNull())
        .join(span, ISSUE)
        .filter(event_ms().between(F.col("first_seen_ms"), F.col("last_seen_ms")))
        .drop("first_seen_ms", "last_seen_ms")
    )


def errors_to_spans(errors: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived errors next to the span or log they came from."""
    left = errors.filter(F.col("source_record_id").isNotNull()).select(
        "project_id", F.col("id").alias("error_id"), F.col("source_record_id").alias("_source"),
        F.col("title").alias("error_title"),
    )
    right = sources.select(
        "project_id", F.col("id").alias("_source"), F.col("signal").alias("source_signal"),
        F.col("name").alias("source_name"), "trace_id", "span_id",
    )
    return left.join(right, ["project_id", "_source"]).withColumnRenamed("_source", "source_record_id")


def active_only(records: DataFrame, projects: DataFrame) -> DataFrame:
    """Records of active projects; the planner broadcasts the project table if small."""
    active = projects.filter(F.col("status") == "active").select("project_id").distinct()
    return records.join(active, "project_id", "left_semi")


def new_only(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Records whose (project, source, source id) is not stored yet.

    De-duplicate the batch first: a group of copies then meets the join as one row.  The
    stored keys are first cut to those in the batch, so a small batch is broadcast over
    the store instead of shuffling every stored key; a large one shares one shuffle.
    """
    keys = ["project_id", "source", "source_id"]
    arriving = batch.filter(F.col("source_id").isNotNull()).select(*keys).distinct()
    known = seen.filter(F.col("source_id").isNotNull()).select(*keys)
    return batch.join(known.join(arriving, keys, "left_semi"), keys, "left_anti")


def trace_spans(records: DataFrame | Archive, project_id: int, trace_id: str, end_ms: int | None = None) -> DataFrame:
    """All spans of one trace: pushed to the scan on ``trace_id``, or by the key index of an archive."""
    if isinstance(records, Archive):
        records = records.lookup("trace_id", trace_id, project_id)
    keep: Column = (
        (F.col("project_id") == project_id)
        & (F.col("signal") == "trace")
        & (F.col("trace_id") == trace_id)
    )
    rows = records.filter(keep)
    return rows if end_ms is None else rows.filter(time_range(0, min(end_ms, LONG_MAX)))
