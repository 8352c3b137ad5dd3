"""Intake of record batches as one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.operators import lookup as J
from signaldeck.operators import ordered as O
from signaldeck.operators import retention as R
from signaldeck.schema import conform
from signaldeck.session import LineageCut
from signaldeck.streaming import jobs as T

INACTIVE, DUPLICATE = "inactive_project", "duplicate"
DECREASE = "metric.cumulative_sum_monotonic_decrease"


def intake(path: str, projects: DataFrame, buckets: int = T.KEY_BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for record batches, below ``path``.

    Records of active projects that are not stored yet are taken (``dedupe``), counter
    readings among them are differenced (``counters``), error records update the issues
    (``issues``), all go to the archive (``archive``) and the change log (``changes``).
    What was accepted, skipped and found amiss is counted (``counts``).  Every step
    writes under the batch's number, so that a replayed batch gives the same tables.
    """
    first_copies = T.dedupe_upsert(f"{path}/dedupe", buckets)
    difference = T.difference_upsert(f"{path}/counters")
    steps = [T.issue_upsert(f"{path}/issues"), T.archive_upsert(f"{path}/archive"), T.change_log(f"{path}/changes")]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A batch is read whole for each use: what only needs the keys reads them from a table.
        cut = LineageCut(spark)
        keys = cut.save(batch.select(*T.DEDUPE_KEYS))
        first_copies(J.active_only(batch, projects), batch_id, J.active_only(keys, projects))
        fresh = spark.read.schema(batch.schema).parquet(f"{path}/dedupe/rows/batch={batch_id}")
        difference(fresh.filter(O.is_reading()), batch_id)
        readings = spark.read.parquet(f"{path}/counters/rows/batch={batch_id}")
        accepted = conform(fresh.filter(O.is_no_reading())).unionByName(conform(readings))
        for step, rows in zip(steps, (accepted.filter("signal = 'error'"), accepted, accepted), strict=True):
            step(rows, batch_id)
        # Rows per project are counted once, and then split by the project's state.
        active = projects.filter("status = 'active'").select("project_id", F.lit(True).alias("active")).distinct()
        arrived = keys.groupBy("project_id").agg(F.count("*").alias("n")).join(active, "project_id", "left")
        arrived = arrived.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("active"), F.col("n"))).alias("active"))
        arrived = arrived.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "active"))).crossJoin(fresh.agg(F.count("*").alias("fresh")))
        skips = {f"skipped.{INACTIVE}": F.col("n") - F.col("active"), f"skipped.{DUPLICATE}": F.col("active") - F.col("fresh"), "skipped": F.col("n") - F.col("fresh")}
        skipped = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), n.alias("value")) for name, n in skips.items())))
        counts = R.counters(accepted, diagnostics=readings.filter("violation").select(F.lit(DECREASE).alias("name")))
        counts = counts.unionByName(arrived.select(skipped).filter("value > 0"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        cut.clear()

    return upsert


def release(spark: SparkSession, path: str, evicted: DataFrame) -> None:
    """Release what an :func:`intake` under ``path`` keeps about evicted records, between two batches.

    Their source ids are forgotten, so that the records are accepted when they come
    again; their issues retain fewer events, and no latest id that is gone.
    """
    T.release_keys(spark, f"{path}/dedupe", evicted)
    T.release_issues(spark, f"{path}/issues", evicted)
