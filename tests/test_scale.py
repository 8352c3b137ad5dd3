"""Work that must not grow faster than its input: rows over tasks, chunks of a task, bytes written."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import metric, records
from signaldeck.operators import envelopes as E
from signaldeck.operators import ordered as O
from signaldeck.operators import traces
from signaldeck.plans import source_queries, views
from signaldeck.plans.envelope_queries import framed
from signaldeck.session import LineageCut
from signaldeck.streaming import jobs as T
from signaldeck.streaming.intake import intake


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(5000).withColumn("text", F.sha2(F.col("id").cast("string"), 512)).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = views.spread(spark.read.parquet(str(tmp_path / "t")))
        sizes = [n for (n,) in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).select("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 5000 and max(sizes) <= 5000 // spark.sparkContext.defaultParallelism + 10


def test_fields_are_kept_without_asking_all_promoted_ones_for_each(spark):
    event = F.lit('{"timestamp":1,"level":"warning","message":"m","extra":1,"user":{"id":"u"},"release":7}')
    rows = framed(spark.range(3).select(F.col("id").alias("n")), F.format_string('{"event_id":"%032d"}', F.col("n")), F.lit('{"type":"event"}'), event)
    errors = E.events_to_errors(rows).select("fields", "level", "release")
    plan = errors._jdf.queryExecution().optimizedPlan().toJSON()
    assert "ArrayContains" not in plan
    found = [(r.level, r.release, r.user, r.number) for r in errors.select(
        "level", "release", F.try_variant_get("fields", '$["user.id"]', "string").alias("user"), F.try_variant_get("fields", "$.release", "int").alias("number"),
    ).collect()]
    assert found == [("warning", None, "u", 7)] * 3


def test_stateful_differences_keep_whole_numbers_beside_nulls(spark, tmp_path):
    at = 1_700_000_000_000_000_001
    common = {"type": "sum", "temporality": "cumulative", "monotonic": True}
    rows = [
        metric("a", at, 5.0, stream_id="s", start_nano=at, **common), metric("b", at + 1, 8.0, stream_id="s", start_nano=at, **common),
        metric("c", at + 2, 2.0, stream_id="s", start_nano=at + 1, **common), metric("d", at, 1.0, stream_id="t", **common),
        metric("e", at + 1, 4.0, stream_id="t", **common),
    ]
    table = records(spark, rows).coalesce(1)
    table.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    T.use_rocksdb(spark)
    try:
        stream = T.stream_difference(T.stream_records(spark, str(tmp_path / "in"), table.schema), buckets=1).drop("fields")
        assert stream.columns == [*[c for c in table.columns if c != "fields"], "violation"]
        T.run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.parquet(str(tmp_path / "out")).select("id", "start_nano", "value").collect()
    assert {tuple(r) for r in found} == {("a", at, None), ("b", at, 3.0), ("c", at + 1, 2.0), ("d", None, None), ("e", None, 3.0)}


def test_lists_are_shortened_before_all_rows_have_come():
    size, taken = 1000, []

    def batches():
        for i in range(10):
            taken.append(i)
            n = np.arange(i * size, (i + 1) * size)
            enter = np.where(n == 0, traces.START, 2 * n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(enter), pa.array(2 * n)], names=["n", "enter", "leave"])

    out = traces._shorten(batches(), chunk=2 * size)
    first = next(out)
    assert len(taken) == 2
    rest = list(out)
    assert sum(b.num_rows for b in [first, *rest]) == 10 * size
    # What lies before a chunk is pointed to from its rows.
    assert set(rest[0].column("enter").to_pylist()) == {2 * (2 * size) - 1}


def test_payload_files_are_compressed(spark):
    path = source_queries.as_json(spark, spark.range(2000).select(F.lit("text" * 20).alias("text")), "text")
    folder = path.removeprefix("file:")
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 2000 * 80 / 4
    assert spark.read.json(path).count() == 2000


def counter(id, stream, at, value, **more):
    return metric(id, at, value, **{"stream_id": stream, "type": "sum", "temporality": "cumulative", "monotonic": True, "start_nano": 0, **more})


def test_differences_are_joined_by_number_without_a_window(spark):
    rows = [counter(f"r{i}", f"s{i % 50}", i // 50, float(i)) for i in range(500)]
    made = O.difference_cumulative(records(spark, rows), parts=7)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_row" in plan
    assert {r.id: r.value for r in made.collect()} == {r["id"]: 50.0 if r["ts_nano"] else None for r in rows}


def test_copies_of_a_reading_are_told_apart(spark):
    rows = [counter("a", "s", 1, 5.0)] * 3 + [counter("b", "s", 2, 9.0)] * 2
    made = O.difference_cumulative(records(spark, rows)).collect()
    assert sorted((r.id, r.value or 0.0) for r in made) == [("a", 0.0)] * 3 + [("b", 0.0), ("b", 4.0)]


def test_tables_of_a_batch_go_with_it(spark, tmp_path, monkeypatch):
    made = []

    class Noted(LineageCut):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            made.append(self._folder.removeprefix("file:"))

    monkeypatch.setattr(T, "LineageCut", Noted)
    run = T.difference_upsert(str(tmp_path / "c"))
    for batch in range(2):
        run(records(spark, [counter(f"{batch}{i}", f"s{i}", batch, 1.0) for i in range(20)]), batch)
    assert len(made) == 2 and not any(os.path.exists(folder) for folder in made)
    assert spark.read.parquet(str(tmp_path / "c" / "rows")).filter("value = 0").count() == 20


def test_every_record_is_a_reading_or_none(spark):
    cases = [{}, {"signal": None}, {"signal": "log"}, {"type": None}, {"type": "gauge"}, {"temporality": None}, {"stream_id": None}, {"value": None}]
    table = records(spark, [counter(str(i), "s", 1, 1.0) | case for i, case in enumerate(cases)])
    assert [r.id for r in table.filter(O.is_reading()).collect()] == ["0"]
    assert sorted(r.id for r in table.filter(O.is_no_reading()).collect()) == [str(i) for i in range(1, len(cases))]


def test_intake_counts_every_record_once(spark, tmp_path):
    projects = spark.createDataFrame([(1, "active"), (2, "deleting"), (3, None)], "project_id bigint, status string")
    run, log = intake(str(tmp_path / "in"), projects, buckets=3), {"signal": "log", "source": "x", "ts_nano": 1, "received_at_ms": 0}
    rows = [{**log, "project_id": p, "id": f"{p}{k}{i}", "source_id": k} for p in (1, 2, 3, None) for k in ("k", "m", None) for i in range(2)]
    counters = [counter("x", "s", 1, 7.0), counter("y", "s", 2, 5.0)]
    run(records(spark, rows + counters), 0)
    run(records(spark, rows), 1)
    found = {(r.batch, r.name): r.value for r in spark.read.parquet(str(tmp_path / "in" / "counts")).collect()}
    first = {"accepted": 6, "accepted.log": 4, "accepted.metric": 2, "metric.cumulative_sum_monotonic_decrease": 1}
    again = {"accepted": 2, "accepted.log": 2}
    skipped = [{"skipped": 20, "skipped.inactive_project": 18, "skipped.duplicate": 2}, {"skipped": 22, "skipped.inactive_project": 18, "skipped.duplicate": 4}]
    assert found == {(0, k): n for k, n in (first | skipped[0]).items()} | {(1, k): n for k, n in (again | skipped[1]).items()}
