"""Archive with a commit log: lookups, atomic switches, early stop, merging, replays."""

import pytest
from pyspark.sql import functions as F

from helpers import records
from signaldeck.operators import lookup as J
from signaldeck.operators import ordered as O
from signaldeck.operators import retention as R
from signaldeck.operators import search as Q
from signaldeck.sources import snapshots as N
from signaldeck.streaming import jobs as T

DAY = 86_400_000


def log(id, day, project=1, signal="log", **more):
    ms = day * DAY + 5
    return {"project_id": project, "id": id, "signal": signal, "source": "otlp", "source_id": id, "ts_nano": ms * 1_000_000,
            "received_at_ms": ms, "message": f"m-{id}", "raw": "{}", "fields": {"attribute.day": day}, **more}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.fixture
def archive(spark, tmp_path):
    return N.Archive(spark, str(tmp_path / "archive"))


def names(df):
    return sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())


def test_lookup_reads_only_the_files_that_hold_the_key(spark, archive):
    for day in range(6):
        spans = [log(f"s{day}-{k}", day, signal="trace", trace_id=f"t{day // 2}", issue_id=None) for k in range(5)]
        archive.append(records(spark, [*spans, log(f"x{day}", day, 2)]))
    assert len(names(archive.read())) == 12
    one = archive.lookup("id", "s3-2", 1)
    assert ids(one) == ["s3-2"] and len(names(one)) == 1
    trace = J.trace_spans(archive, 1, "t1")
    assert len(ids(trace)) == 10 and len(names(trace)) == 2
    assert ids(J.get_record(records(spark, [log("h", 9)]), 1, "s0-0", archive)) == ["s0-0"]
    assert ids(archive.lookup("id", "s3-2", 2)) == [] and ids(archive.lookup("id", "none", 1)) == []
    with pytest.raises(ValueError):
        archive.lookup("message", "m", 1)


def test_key_index_is_pruned_by_hash(spark, archive):
    archive.append(records(spark, [log(f"r{k}", k % 3) for k in range(50)]))
    keys = archive._live("keys", N.KEYS_DDL, None).where((F.col("field") == "id") & (F.col("hash") == F.xxhash64(F.lit("r7"))))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(hash), EqualTo(hash" in plan and "field#" in plan[plan.index("PartitionFilters"):]


def test_failure_between_the_writes_of_a_compaction(spark, archive, monkeypatch):
    archive.append(records(spark, [log("a", 0)]))
    hot = records(spark, [log("a", 0), log("b", 0), log("c", 3)])
    before = (archive.version(), ids(archive.records()))

    def fail(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(archive, "_commit", fail)
    with pytest.raises(RuntimeError):
        archive.compact(hot, DAY)
    monkeypatch.undo()
    assert (archive.version(), ids(archive.records())) == before
    archive.compact(hot, DAY)
    assert ids(archive.read()) == ["a", "b"] and ids(archive.hot()) == ["c"] and ids(archive.records()) == ["a", "b", "c"]
    assert ids(archive.records(before[0])) == ["a"]


def test_commits_do_not_overwrite_each_other(spark, archive):
    archive.append(records(spark, [log("a", 0)]))
    other = N.Archive(spark, archive.path)
    after = archive.version()
    other.append(records(spark, [log("b", 0)]))
    with pytest.raises(N.CommitConflict):
        archive._commit(after, added=archive._write(records(spark, [log("c", 0)])))
    assert ids(archive.read()) == ["a", "b"]
    archive.append(records(spark, [log("c", 0)]))
    assert ids(other.read()) == ["a", "b", "c"]


def test_manifest_eviction_merging_and_vacuum(spark, archive):
    rows = [log("a", 0), log("b", 0, 2), log("c", 1), log("d", 2), log("e", 2, signal="error"), log("f", 2)]
    for row in rows:
        archive.append(records(spark, [row]))
    table = records(spark, rows)
    want = R.manifest(table).select("project_id", "signal", "receive_date", "records", "logical_bytes", "min_event_ms", "max_received_ms")
    assert sorted(archive.manifest().select(*want.columns).collect()) == sorted(want.collect())
    assert archive.files().count() == 6 and archive.merge_small(100) is not None and archive.files().count() == 5
    assert archive.merge_small(100) is None and ids(archive.read()) == list("abcdef")
    total = want.agg(F.sum("logical_bytes")).first()[0]
    archive.drop(O.evict_plan(archive.manifest(), total - 1))
    assert ids(archive.read()) == list("bcdef") and ids(archive.lookup("id", "a", 1)) == []
    assert archive.vacuum(archive.version()) == 3 and ids(archive.read()) == list("bcdef")


def test_bases_keep_what_was_committed(spark, tmp_path):
    archive = N.Archive(spark, str(tmp_path / "archive"), fanout=3)
    for k in range(8):
        archive.append(records(spark, [log(f"r{k}", k % 2, trace_id=f"t{k}")]))
    assert len(archive.entries()) <= 4 and archive.entries()[0].base
    assert ids(archive.read()) == [f"r{k}" for k in range(8)] and ids(archive.lookup("trace_id", "t2", 1)) == ["r2"]


def test_newest_page_stops_early(spark, archive):
    for month in range(12):
        archive.append(records(spark, [log(f"r{month:02d}-{k}", month * 30 + k % 3) for k in range(9)]))
    page = archive.newest_page(1, "log", limit=4)
    assert [r.id for r in page.sort(F.desc("ts_nano"), F.desc("id")).collect()] == ["r11-8", "r11-5", "r11-2", "r11-7"]
    assert len(names(page)) <= 2 < len(names(archive.read()))
    cursor = Q.next_cursor(page.collect())
    everything = archive.read(1, "log")
    assert ids(archive.newest_page(1, "log", limit=4, cursor=cursor)) == ids(Q.page(everything, 4, cursor))
    # A predicate that only the oldest file satisfies reads on to it; no match gives no row.
    old = Q.eq("day", 1)
    assert ids(archive.newest_page(1, "log", old, 2)) == ids(Q.page(everything.filter(old), 2))
    assert archive.newest_page(1, "log", Q.eq("day", 999), 2).count() == 0 and archive.newest_page(3, "log").count() == 0


def test_stream_batches_are_committed_once(spark, archive):
    write = T.archive_commit(archive)
    for batch, rows in enumerate([[log("a", 0)], [log("b", 0), log("c", 1)], [log("d", 1)]]):
        write(records(spark, rows), batch)
        write(records(spark, rows), batch)  # replayed
    assert archive.version() == 2 and ids(archive.read()) == list("abcd")


def test_nothing_written_yet(spark, archive):
    assert archive.version() == -1 and archive.read().count() == 0 and archive.records().count() == 0
    assert archive.lookup("id", "a", 1).count() == 0 and archive.merge_small(5) is None
    archive.append(records(spark, [log("a", 0)]).where("false"))
    assert archive.read().count() == 0 and archive.manifest().count() == 0
