"""Levelled state: what is written, replays, expiry, and the release of evicted records."""


from pyspark.sql import functions as F

from helpers import records
from signaldeck.streaming import jobs as T
from signaldeck.streaming.intake import intake, release
from signaldeck.streaming.state import DeltaState

ROW = {"project_id": 1, "signal": "log", "source": "x", "received_at_ms": 0, "ts_nano": 1}


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def state_of(spark, path, **more):
    return DeltaState(spark, str(path), ["k"], summed, **more)


def content(df):
    return {r.k: r.n for r in df.collect()}


def test_runs_are_merged_and_versions_stay_readable(spark, tmp_path):
    state = state_of(spark, tmp_path / "s", buckets=3, fanout=3)
    sizes = []
    for batch in range(11):
        state.update(spark.createDataFrame([(k, 1) for k in range(batch, batch + 4)], "k int, n bigint"), batch)
        sizes.append(len(state._before(None)))
    assert max(sizes) <= 2 * 3 and content(state.read()) == {k: min(k + 1, 4, 14 - k) for k in range(14)}
    assert content(state.read(9)) == {k: min(k + 1, 4, 13 - k) for k in range(13)}
    # A batch writes rows of its own; merging adds a share that does not grow with the store.
    assert len(state.versions()) <= 8
    runs = {p.name for p in (tmp_path / "s" / "runs").iterdir()}
    assert "run=0-0-0" not in runs and "run=10-0-0" in runs


def test_a_replay_gives_the_same_state(spark, tmp_path):
    state = state_of(spark, tmp_path / "s", fanout=2)
    parts = [spark.createDataFrame([(k % 3, 1) for k in range(n)], "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")) for n in (3, 5, 7)]
    for batch, part in enumerate(parts):
        state.update(part, batch)
        before = content(state.read())
        state_of(spark, tmp_path / "s", buckets=99).update(part, batch)
        assert content(state_of(spark, tmp_path / "s").read()) == before
    state.update(parts[1], 1)
    assert content(state.read()) == before and content(state.read(1)) == {0: 3, 1: 3, 2: 2}


def test_no_rows_and_touched_buckets(spark, tmp_path):
    state = state_of(spark, tmp_path / "s", buckets=5)
    assert state.read() is None and state.before(0) is None
    state.update(spark.createDataFrame([], "k int, n bigint"), 0)
    assert content(state.read()) == {}
    state.update(spark.createDataFrame([(k, k) for k in range(40)], "k int, n bigint"), 1)
    some = spark.createDataFrame([(7,)], "k int")
    held = content(state.before(2, state.touched(some)))
    assert 7 in held and 0 < len(held) < 40


def test_a_record_comes_again_after_its_eviction(spark, tmp_path):
    path = str(tmp_path / "out")
    first = [{**ROW, "id": "a", "source_id": "k"}, {**ROW, "id": "b", "source_id": "m"}]
    run = T.dedupe_upsert(path, buckets=3)
    run(records(spark, first), 0)
    T.release_keys(spark, path, records(spark, first[:1]))
    again = [{**ROW, "id": "a2", "source_id": "k"}, {**ROW, "id": "b2", "source_id": "m"}]
    for _ in range(2):  # the second time as a replay
        run(records(spark, again), 1)
        assert {r.id for r in spark.read.parquet(f"{path}/rows").collect()} == {"a", "b", "a2"}
    run(records(spark, again), 2)
    assert {r.id for r in spark.read.parquet(f"{path}/rows").collect()} == {"a", "b", "a2"}


def error(id, ts, title="t", **more):
    return {**ROW, "id": id, "source_id": id, "signal": "error", "ts_nano": ts, "issue_title": title, "level": "error", **more}


def test_intake_releases_keys_and_issue_counts(spark, tmp_path):
    path = str(tmp_path / "in")
    projects = spark.createDataFrame([(1, "active")], "project_id bigint, status string")
    run = intake(path, projects, buckets=3)
    rows = [error("a", 10), error("b", 20), error("c", 30), error("d", 5, "other")]
    run(records(spark, rows), 0)
    release(spark, path, records(spark, [rows[2], rows[3]]))
    issues = {r.title: (r.total_seen, r.retained_events, r.latest_record_id) for r in T.stored_issues(spark, f"{path}/issues").collect()}
    assert issues == {"t": (3, 2, None), "other": (1, 0, None)}
    run(records(spark, [rows[2], rows[0]]), 1)
    counts = {r.name: r.value for r in spark.read.parquet(f"{path}/counts/batch=1").collect()}
    assert counts["accepted"] == 1 and counts["skipped.duplicate"] == 1
    issues = {r.title: (r.total_seen, r.retained_events) for r in T.stored_issues(spark, f"{path}/issues").collect()}
    assert issues == {"t": (4, 3), "other": (1, 0)}
