"""Archive layout, compaction, eviction and status on real files."""

from pathlib import Path

from pyspark.sql import functions as F

from helpers import records
from signaldeck.operators import ordered as O
from signaldeck.operators import retention as R
from signaldeck.operators import search as Q
from signaldeck.sources import archive as A

DAY = 86_400_000


def log(id, day, project=1, signal="log", **more):
    ms = day * DAY + 5
    return {"project_id": project, "id": id, "signal": signal, "source": "otlp", "source_id": id, "ts_nano": ms * 1_000_000,
            "received_at_ms": ms, "message": f"m-{id}", "raw": "{}", "fields": {"attribute.day": day}, **more}


def sample(spark):
    return records(spark, [log("a", 0), log("b", 0, 2), log("c", 1), log("d", 2), log("e", 2, signal="error")])


def test_archive_layout_and_pruned_reads(spark, tmp_path):
    path = str(tmp_path / "archive")
    A.write_archive(sample(spark), path)
    assert (Path(path) / "project=1" / "signal=log" / "date=1970-01-02").is_dir()
    assert list(Path(path).rglob("*.zstd.parquet"))
    rows = A.read_archive(spark, path, 1, "log", 0, DAY + 10, predicate=Q.ge("day", 1))
    assert [(r.id, r.project_id, r.message) for r in rows.collect()] == [("c", 1, "m-c")]
    assert A.read_archive(spark, path, 1, "log", record_id="d").count() == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    partition = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "project" in partition and "signal" in partition
    back = A.open_archive(spark, path)
    assert back.filter(F.try_variant_get("fields", '$["attribute.day"]', "int") == 2).count() == 2


def test_one_heavy_partition_is_split(spark, tmp_path):
    """A partition with most rows is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        heavy = records(spark, [log("x", 0)]).drop("id", "raw").crossJoin(spark.range(20_000).select(
            F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("raw")))
        A.write_archive(heavy.repartition(8), str(tmp_path / "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "h").rglob("*.parquet"))) > 2


def test_compaction_can_be_repeated(spark, tmp_path):
    hot, archive = sample(spark), str(tmp_path / "archive")
    R.compact(hot, archive, str(tmp_path / "hot1"), DAY)
    done = A.open_archive(spark, archive)
    R.compact(hot, archive, str(tmp_path / "hot2"), DAY, archived=done)  # rerun after a failure
    old, recent = A.open_archive(spark, archive), spark.read.parquet(str(tmp_path / "hot2"))
    assert sorted(r.id for r in old.collect()) == ["a", "b"] and sorted(r.id for r in recent.collect()) == ["c", "d", "e"]
    both = A.read_records(recent, old)
    assert both.count() == 5 and A.read_records(hot, old).count() == 5


def test_eviction_drops_whole_partitions(spark, tmp_path):
    path = str(tmp_path / "archive")
    table = sample(spark)
    A.write_archive(table, path)
    parts = R.manifest(table)
    first = parts.orderBy("min_received_ms", "project_id").first()
    total = parts.agg(F.sum("logical_bytes")).first()[0]
    plan = O.evict_plan(parts, total - first.logical_bytes)
    assert [(r.project_id, r.signal) for r in plan.collect()] == [(1, "log")]
    assert sorted(r.id for r in R.apply_eviction(table, plan).collect()) == ["b", "c", "d", "e"]
    assert R.drop_partitions(path, plan) == 1
    assert sorted(r.id for r in A.open_archive(spark, path).collect()) == ["b", "c", "d", "e"]


def test_manifest_bounds_and_status(spark):
    table = R.with_size(sample(spark))
    parts = R.manifest(table, "logical_bytes")
    row = parts.filter("project_id = 1 and signal = 'log' and receive_date = '1970-01-03'").first()
    assert (row.records, row.min_event_ms, row.max_received_ms) == (1, 2 * DAY + 5, 2 * DAY + 5)
    total = parts.agg(F.sum("logical_bytes")).first()[0]
    assert R.storage_status(parts, total).first() == (5, total, True)
    assert not R.storage_status(parts, total * 2).first().storage_warning
    old, hot = R.split_by_arrival(table, DAY)
    assert R.storage_status(R.manifest(old, "logical_bytes"), total, hot).first().records == 5


def test_counters(spark):
    rejects = spark.createDataFrame([("otlp.invalid_span",)] * 2, "reason string")
    diagnostics = spark.createDataFrame([("odd",)], "name string")
    got = {r.name: r.value for r in R.counters(sample(spark), rejects, diagnostics).collect()}
    assert got == {"accepted": 5, "accepted.log": 4, "accepted.error": 1, "skipped": 2, "skipped.otlp.invalid_span": 2, "odd": 1}
