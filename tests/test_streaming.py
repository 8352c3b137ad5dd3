"""Streaming jobs over several batches, with restarts from the checkpoint."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import records
from signaldeck.operators import otel as O
from signaldeck.sources.archive import open_archive
from signaldeck.sources.otel import otel_ddl, with_arrival
from signaldeck.streaming import jobs as T
from test_ordered import ERRORS, reading


class Inbox:
    """Folder of arriving record files, drained batch by batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def arrive(self, rows):
        records(self.spark, rows).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def stream(self):
        return T.stream_records(self.spark, str(self.folder / "in"), maxFilesPerTrigger="1")

    def drain(self, writer):
        T.run_available(writer, str(self.folder / "checkpoint"))


@pytest.fixture
def inbox(spark, tmp_path):
    return Inbox(spark, tmp_path)


FIRST = [reading("a", "s", 1_000, 0, 7), reading("b", "t", 1_000, 0, 5)]
SECOND = [reading("c", "s", 2_000, 0, 9), reading("late", "s", 500, 0, 8), reading("d", "t", 2_000, 0, 3),
          reading("e", "t", 3_000, 0, 6)]
DELTAS = {"a": None, "b": None, "c": 2.0, "late": None, "d": None, "e": 1.0}


def test_difference_state_survives_a_restart(inbox, spark):
    path = str(inbox.folder / "out")
    for rows in (FIRST, SECOND):
        inbox.arrive(rows)
        inbox.drain(inbox.stream().writeStream.foreachBatch(T.difference_upsert(path)))
    rows = spark.read.parquet(path + "/rows").collect()
    assert {r.id: r.value for r in rows} == DELTAS
    assert [r.id for r in rows if r.violation] == ["d"]


def test_stateful_difference(inbox, spark):
    T.use_rocksdb(spark)
    path = str(inbox.folder / "out")
    for rows in (FIRST, SECOND):
        inbox.arrive(rows)
        out = T.stream_difference(inbox.stream()).select("id", "value", "violation")
        inbox.drain(out.writeStream.format("parquet").option("path", path))
    rows = spark.read.parquet(path).collect()
    assert {r.id: r.value for r in rows} == DELTAS
    assert [r.id for r in rows if r.violation] == ["d"]


def test_issue_rollup_over_batches(inbox, spark):
    path = str(inbox.folder / "issues")
    for rows in (ERRORS[1:3], ERRORS[:1] + ERRORS[3:]):
        inbox.arrive(rows)
        inbox.drain(inbox.stream().writeStream.foreachBatch(T.issue_upsert(path)))
    rows = T.stored_issues(spark, path).collect()
    assert sorted((r.project_id, r.total_seen) for r in rows) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    run = next(r for r in rows if r.total_seen == 2)
    assert (run.title, run.level, run.first_seen_ms, run.last_seen_ms, run.latest_record_id) == ("last", "fatal", 10, 30, "b")


def test_dedupe_keeps_late_records(inbox, spark):
    row = {"project_id": 1, "signal": "log", "source": "x", "received_at_ms": 0}
    day = 86_400 * 10**9
    first = [{**row, "id": "a", "source_id": "k", "ts_nano": 50 * day}, {**row, "id": "b", "source_id": "k", "ts_nano": 51 * day}]
    late = [{**row, "id": "c", "source_id": "old", "ts_nano": day}, {**row, "id": "d", "source_id": "k", "ts_nano": 52 * day},
            {**row, "id": "e", "source_id": None, "ts_nano": day}]
    path = str(inbox.folder / "out")
    for rows in (first, late, [{**row, "id": "f", "source_id": "old", "ts_nano": day}]):
        inbox.arrive(rows)
        inbox.drain(inbox.stream().writeStream.foreachBatch(T.dedupe_upsert(path, buckets=3)))
    assert {r.id for r in spark.read.parquet(f"{path}/rows").collect()} == {"a", "c", "e"}
    # A replay of the second batch writes the same rows.
    T.dedupe_upsert(path, buckets=3)(records(spark, late), 1)
    assert {r.id for r in spark.read.parquet(f"{path}/rows").collect()} == {"a", "c", "e"}
    stateful = str(inbox.folder / "stateful")
    T.run_available(T.stream_dedupe(inbox.stream()).select("source_id").writeStream.format("parquet").option("path", stateful), str(inbox.folder / "c"))
    assert sorted(str(r[0]) for r in spark.read.parquet(stateful).collect()) == ["None", "k", "old"]


def test_changes_and_archive(inbox, spark):
    row = {"project_id": 1, "id": "a", "signal": "log", "source": "otlp", "source_id": "k", "ts_nano": 5_000_000_000, "received_at_ms": 0}
    out, log = str(inbox.folder / "archive"), str(inbox.folder / "log")

    def both(batch, number):
        T.archive_upsert(out)(batch, number)
        T.change_log(log)(batch, number)

    for rows in ([row, {**row, "id": "b"}], [{**row, "project_id": 2}]):
        inbox.arrive(rows)
        inbox.drain(inbox.stream().writeStream.foreachBatch(both))
    rows = open_archive(spark, out).collect()
    assert len(rows) == 3 and {str(r.date) for r in rows} == {"1970-01-01"}
    assert sorted(spark.read.parquet(log).select("project_id", "signal", "sequence").collect()) == [(1, "log", 0), (2, "log", 1)]


def test_new_records(spark):
    row = {"project_id": 1, "signal": "log", "source": "x", "ts_nano": 0, "received_at_ms": 0}
    batch = records(spark, [{**row, "id": "a", "source_id": "1"}, {**row, "id": "b", "source_id": "1"},
                            {**row, "id": "c", "source_id": "2"}, {**row, "id": "d", "source_id": None},
                            {**row, "id": "e", "source_id": "3", "project_id": 2}])
    stored = records(spark, [{**row, "id": "z", "source_id": "2"}])
    projects = spark.createDataFrame([(1, "active"), (2, "deleting")], "project_id bigint, status string")
    assert {r.id for r in T.new_records(batch, stored, projects).collect()} == {"a", "d"}


def test_series_and_observed_counts(inbox, spark):
    rows = [{"project_id": 1, "id": str(i), "signal": "metric", "name": "m", "value": float(i), "ts_nano": i * 1_000_000_000}
            for i in range(10)]
    base = inbox.folder
    for part in (rows[5:], rows[:5]):  # the second arrival is late
        inbox.arrive(part)
        T.run_available(inbox.stream().writeStream.foreachBatch(T.series_upsert(str(base / "w"), 4_000, 1_000)), str(base / "c"))
    got = sorted((r.bucket_ms, r["sum"], r["count"]) for r in T.stored_series(spark, str(base / "w")).collect())
    assert got == [(-3_000, 0.0, 1), (1_000, 10.0, 4), (5_000, 26.0, 4), (9_000, 9.0, 1)]
    query = (T.observed(inbox.stream()).writeStream.format("noop").trigger(availableNow=True)
             .option("checkpointLocation", str(base / "o")).start())
    query.awaitTermination()
    seen = [p.observedMetrics["accepted"] for p in query.recentProgress if "accepted" in p.observedMetrics]
    assert sum(s.accepted for s in seen) == 10 and sum(s.accepted_metric for s in seen) == 10


def test_export_requests_as_a_stream(inbox, spark):
    folder = inbox.folder / "json"
    folder.mkdir()
    log = {"body": {"string_value": "hi"}, "severity_number": 9, "time_unix_nano": 4}
    (folder / "a.json").write_text(json.dumps({"resource_logs": [{"scope_logs": [{"log_records": [log]}]}]}))
    batches = with_arrival(T.stream_records(spark, str(folder), otel_ddl("logs"), "json"), 1, 9)
    out = O.otel_logs(batches).select("message", "level", F.col("ts_nano"))
    T.run_available(out.writeStream.format("parquet").option("path", str(inbox.folder / "o")), str(inbox.folder / "c"))
    assert spark.read.parquet(str(inbox.folder / "o")).collect() == [("hi", "info", 4)]
