"""Date-partitioned Parquet archive and the hot + archive record table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.operators.search import LONG_MAX, time_range
from signaldeck.schema import RECORD_COLUMNS

# Partition directories: project=<id>/signal=<name>/date=<UTC arrival date>.
PARTITION = ["project", "signal", "date"]

# Columns of archived records as DDL: known beforehand, so that no file footer is read for them.
ARCHIVE_DDL = ", ".join(
    f"`{name}` {kind}"
    for name, kind in {
        **{c: k for c, k in RECORD_COLUMNS.items() if c not in ("project_id", "signal")},
        "project": "bigint", "signal": "string", "date": "date",
    }.items()
)


def partitioned(records: DataFrame) -> DataFrame:
    """Records with their partition columns, ``project_id`` renamed to ``project``."""
    return records.withColumn("date", S.receive_date(F.col("received_at_ms"))).withColumnRenamed(
        "project_id", "project"
    )


def write_archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records as zstd Parquet under project / signal / date.

    ``rebalance`` gathers a partition's rows into files of the advisory size and, under
    AQE, splits a partition that holds far more rows than the others over many tasks.
    Sorting by name and time gives row groups narrow bounds for later pruning.
    """
    (
        partitioned(records)
        .hint("rebalance", *PARTITION)
        .sortWithinPartitions(*PARTITION, "name", "ts_nano")
        .write.mode(mode)
        .partitionBy(*PARTITION)
        .option("compression", "zstd")
        .parquet(path)
    )


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole archive as a record table; columns are united over files by name."""
    table = spark.read.option("mergeSchema", "true").parquet(path)
    return table.withColumn("project_id", F.col("project").cast("bigint")).drop("project")


def read_archive(spark: SparkSession, path: str, project_id: int, signal: str, start_ms: int = 0,
                 end_ms: int = LONG_MAX // 1_000_000, record_id: str | None = None,
                 predicate: Column | None = None) -> DataFrame:
    """Archived records of one project and signal in an event-time range.

    Project and signal prune directories; time and id are pushed to the row groups.
    Columns that a file lacks are NULL.
    """
    table = spark.read.schema(ARCHIVE_DDL).parquet(path)
    rows = table.filter((F.col("project") == project_id) & (F.col("signal") == signal))
    rows = rows.filter(time_range(start_ms, end_ms))
    if record_id is not None:
        rows = rows.filter(F.col("id") == record_id)
    rows = rows.withColumn("project_id", F.col("project").cast("bigint")).drop("project", "date")
    return rows if predicate is None else rows.filter(predicate)


def read_records(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Logical record table: hot and archived rows, one per (project, id); the hot row wins.

    The archive is not shuffled where the hot ids fit a broadcast: they are what the join
    needs, and Spark decides by their size.
    """
    key = ["project_id", "id"]
    recent = hot.dropDuplicates(key)
    older = archive.join(recent.select(*key), key, "left_anti").select(*archive.columns)
    return recent.unionByName(older, allowMissingColumns=True)
