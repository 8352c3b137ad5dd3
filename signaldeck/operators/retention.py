"""Storage jobs: partition manifest, compaction, eviction, deletion, status, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.operators import issues as I
from signaldeck.operators import ordered as O
from signaldeck.schema import event_ms
from signaldeck.sources.archive import write_archive

PARTITION = ["project_id", "signal", "receive_date"]
WARNING_SHARE = 0.8


def with_size(records: DataFrame) -> DataFrame:
    """Add ``logical_bytes``, the length of the record's JSON text."""
    return records.withColumn("logical_bytes", S.logical_bytes(*records.columns))


def manifest(records: DataFrame, size: str | None = None) -> DataFrame:
    """Per archive partition: rows, event and arrival bounds, logical bytes."""
    amount = F.col(size) if size else S.logical_bytes(*records.columns)
    return (
        records.withColumn("receive_date", S.receive_date(F.col("received_at_ms")))
        .groupBy(*PARTITION)
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.min(event_ms()).alias("min_event_ms"),
            F.max(event_ms()).alias("max_event_ms"),
            F.min("received_at_ms").alias("min_received_ms"),
            F.max("received_at_ms").alias("max_received_ms"),
            F.sum(amount).cast("bigint").alias("logical_bytes"),
        )
    )


def split_by_arrival(records: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows that stay hot)."""
    old = F.col("received_at_ms") < cutoff_ms
    return records.filter(old), records.filter(~old)


def compact(hot: DataFrame, archive_path: str, next_hot_path: str, cutoff_ms: int,
            archived: DataFrame | None = None) -> None:
    """Move records received before the cutoff into the archive.

    The remaining rows are written to ``next_hot_path``; the caller switches to it
    once this returns.  After a failure between the two writes, rerun with
    ``archived`` (the archive as it is): rows already there are not added again.
    """
    old, recent = split_by_arrival(hot, cutoff_ms)
    if archived is not None:
        # Only what arrived in the time that is moved can be there twice.
        first = old.agg(F.min("received_at_ms")).first()[0]
        moved = F.col("received_at_ms").between(first if first is not None else cutoff_ms, cutoff_ms - 1)
        done = archived.filter(moved).select("project_id", "id")
        old = old.join(done, ["project_id", "id"], "left_anti")
    write_archive(old, archive_path)
    recent.write.mode("overwrite").option("compression", "zstd").parquet(next_hot_path)


def apply_eviction(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Records outside the evicted partitions.

    Recount issues with :func:`signaldeck.operators.issues.retained`; a store that keeps
    keys and issues by batch releases them with :func:`signaldeck.streaming.intake.release`.
    """
    dated = records.withColumn("receive_date", S.receive_date(F.col("received_at_ms")))
    return dated.join(plan.select(*PARTITION), PARTITION, "left_anti").select(*records.columns)


def evict(records: DataFrame, issue_table: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply an eviction plan to records and issues together."""
    kept = apply_eviction(records, plan)
    return kept, I.retained(issue_table, kept)


def enforce_target(manifest_table: DataFrame, hot: DataFrame, issue_table: DataFrame, target_bytes: int,
                   size: str = "logical_bytes") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to drop so that archive, hot records and issues together fit the target.

    Returns the archive partitions, hot records and issues to evict: archive partitions
    oldest first, then hot records, then issues, each for what the stage before left over.
    Hot records and issues have their bytes in column ``size``.  Evicted records release
    their keys; recount the issues that stay with :func:`evict`.
    """
    total = lambda df, column: df.agg(F.sum(column)).first()[0] or 0
    archived, recent, issues = total(manifest_table, "logical_bytes"), total(hot, size), total(issue_table, size)
    plan = O.evict_plan(manifest_table, target_bytes, recent + issues)
    archived -= total(plan, "logical_bytes")
    dropped = O.evict_hot(hot, target_bytes, archived + issues, size)
    recent -= total(dropped, size)
    return plan, dropped, O.evict_issues(issue_table, target_bytes, archived + recent, size)


def delete_project(df: DataFrame, project_id: int) -> DataFrame:
    """Everything but one project's rows (works on records, issues and manifests)."""
    return df.filter(F.col("project_id") != project_id)


def storage_status(manifest_table: DataFrame, target_bytes: int, hot: DataFrame | None = None,
                   size: str = "logical_bytes") -> DataFrame:
    """Records, logical bytes and the 80 % warning flag, as one row."""
    parts = manifest_table.select("records", F.col("logical_bytes").alias("bytes"))
    if hot is not None:
        parts = parts.unionByName(
            hot.select(F.lit(1).cast("bigint").alias("records"), F.col(size).alias("bytes"))
        )
    warning = F.col("logical_bytes") >= F.lit(target_bytes * 4 // 5)
    return parts.agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("bigint").alias("records"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("logical_bytes"),
    ).withColumn("storage_warning", warning)


def counters(accepted: DataFrame, rejects: DataFrame | None = None,
             diagnostics: DataFrame | None = None) -> DataFrame:
    """Named totals: accepted, accepted.<signal>, skipped, skipped.<reason>, diagnostics.

    ``rejects`` and ``diagnostics`` have a ``reason`` / ``name`` column, one row each.
    """

    def named(df: DataFrame, total: str | None, label: str) -> DataFrame:
        per = df.groupBy(label).agg(F.count(F.lit(1)).alias("value"))
        if total is None:
            return per.select(F.col(label).alias("name"), "value")
        each = per.select(F.concat(F.lit(f"{total}."), F.col(label)).alias("name"), "value")
        whole = per.agg(F.sum("value").cast("bigint").alias("value")).select(
            F.lit(total).alias("name"), "value"
        )
        return whole.filter(F.col("value").isNotNull()).unionByName(each)

    result = named(accepted, "accepted", "signal")
    if rejects is not None:
        result = result.unionByName(named(rejects, "skipped", "reason"))
    if diagnostics is not None:
        result = result.unionByName(named(diagnostics, None, "name"))
    return result


def drop_partitions(df_path: str, plan: DataFrame) -> int:
    """Delete the directories of evicted partitions; returns how many existed.

    Works on directory names only (one per plan row, streamed), never on records.
    """
    spark = plan.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    for row in plan.select(*PARTITION).toLocalIterator():
        name = f"{df_path}/project={row.project_id}/signal={row.signal}/date={row.receive_date}"
        target = jvm.org.apache.hadoop.fs.Path(name)
        dropped += bool(target.getFileSystem(conf).delete(target, True))
    return dropped


