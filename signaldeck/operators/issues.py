"""Issue rollup: errors grouped by fingerprint.

Every piece of an issue is an associative aggregate (min, max, sum, value at the
min or max), so a hot issue is combined on the map side before the shuffle and
rollups of different batches merge into one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.schema import event_ms

ISSUE_COLUMNS = (
    "project_id issue_id title level first_seen_ms last_seen_ms total_seen retained_events "
    "latest_record_id"
).split()


def with_issue_id(errors: DataFrame) -> DataFrame:
    """Set ``issue_id`` on error records; other signals keep none."""
    return errors.withColumn(
        "issue_id",
        F.when(
            F.col("signal") == "error",
            ids.issue_id(F.col("issue_title"), F.col("issue_fingerprint")),
        ),
    )


def issue_state(errors: DataFrame) -> DataFrame:
    """Rollup with its merge keys; :func:`merge_issue_state` combines such tables."""
    key, ms = F.struct(F.col("ts_nano"), F.col("id")).alias("key"), event_ms().alias("ms")
    first = F.struct(F.coalesce(F.col("level"), F.lit("error")).alias("level"), ms)
    last = F.struct(F.coalesce(F.col("issue_title"), F.lit("Error")).alias("title"), F.col("id").alias("record"), ms)
    # Every structure is compared and kept row by row: one for each end.
    ends = errors.filter(
        (F.col("signal") == "error") & F.col("issue_id").isNotNull()
    ).groupBy("project_id", "issue_id").agg(
        F.min(F.struct(key, first.alias("of"))).alias("first"), F.max(F.struct(key, last.alias("of"))).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    return ends.select(
        "project_id", "issue_id", F.col("first.of").alias("_first"), F.col("last.of").alias("_last"),
        F.col("last.key").alias("_last_key"), F.col("first.key").alias("_first_key"),
        F.col("n").alias("total_seen"), F.col("n").alias("retained_events"),
        F.lit(None).cast("struct<ts_nano: bigint, id: string>").alias("_evicted"),
    )


def evicted_state(errors: DataFrame) -> DataFrame:
    """What evicted error records take from a rollup: retained events, and the latest id if it is theirs."""
    gone = errors.filter((F.col("signal") == "error") & F.col("issue_id").isNotNull())
    state = issue_state(gone)
    none = lambda c: F.lit(None).cast(state.schema[c].dataType).alias(c)
    return state.select(
        "project_id", "issue_id", *(none(c) for c in ("_first", "_last", "_last_key", "_first_key")),
        F.lit(0).cast("bigint").alias("total_seen"), (-F.col("retained_events")).alias("retained_events"), F.col("_last_key").alias("_evicted"),
    )


def merge_issue_state(*states: DataFrame) -> DataFrame:
    """One rollup out of several (stored and new)."""
    union = states[0]
    for state in states[1:]:
        union = union.unionByName(state)
    return union.groupBy("project_id", "issue_id").agg(
        F.min_by("_first", "_first_key").alias("_first"),
        F.max_by("_last", "_last_key").alias("_last"),
        F.max("_last_key").alias("_last_key"),
        F.min("_first_key").alias("_first_key"),
        F.sum("total_seen").cast("bigint").alias("total_seen"),
        F.sum("retained_events").cast("bigint").alias("retained_events"),
        F.max("_evicted").alias("_evicted"),
    )


def issue_rows(state: DataFrame) -> DataFrame:
    """Public issue columns of a rollup; an issue whose latest record was evicted has no latest id."""
    return state.filter(F.col("_last_key").isNotNull()).select(
        "project_id",
        "issue_id",
        F.col("_last.title").alias("title"),
        F.col("_first.level").alias("level"),
        F.col("_first.ms").alias("first_seen_ms"),
        F.col("_last.ms").alias("last_seen_ms"),
        "total_seen",
        F.greatest("retained_events", F.lit(0)).alias("retained_events"),
        F.when(~F.col("_last_key").eqNullSafe(F.col("_evicted")), F.col("_last.record")).alias("latest_record_id"),
    )


def issues(errors: DataFrame) -> DataFrame:
    """Issues of error records: level of the first event, title and id of the latest."""
    return issue_rows(issue_state(errors))


def retained(issue_table: DataFrame, records: DataFrame) -> DataFrame:
    """Recount the still-stored events and drop latest ids that were evicted."""
    keys = ["project_id", "issue_id"]
    errors = records.filter(F.col("issue_id").isNotNull())
    counts = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_stored"))
    # Issues hold one latest id each, so the planner may broadcast this side.
    latest = issue_table.filter(F.col("latest_record_id").isNotNull()).select(
        *keys, F.col("latest_record_id").alias("id")
    )
    present = (
        errors.select(*keys, "id")
        .join(latest, [*keys, "id"])
        .select(*keys, F.col("id").alias("_present"))
        .distinct()
    )
    return (
        issue_table.join(counts, keys, "left")
        .join(present, keys, "left")
        .withColumns(
            {
                "retained_events": F.coalesce("_stored", F.lit(0).cast("bigint")),
                "latest_record_id": F.col("_present"),
            }
        )
        .select(*issue_table.columns)
    )
