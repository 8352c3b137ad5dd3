"""Counter differencing, de-duplication, eviction and issues."""

import random

import pytest

from helpers import records
from signaldeck.operators import counters as C
from signaldeck.operators import issues as I
from signaldeck.operators import ordered as O


def reading(id, stream, ts, start, value, monotonic=True):
    return {"project_id": 1, "id": id, "signal": "metric", "source": "otlp", "type": "sum", "temporality": "cumulative",
            "stream_id": stream, "ts_nano": ts, "start_nano": start, "value": float(value), "monotonic": monotonic,
            "received_at_ms": 0}


SEC = 1_000_000_000
# Two monotonic streams, one restarted twice, and one that may fall.
FIXTURE = [
    (reading("a1", "up", 1 * SEC, 7, 100), None),
    (reading("a2", "up", 3 * SEC, 7, 100), 0.0),
    (reading("a3", "up", 4 * SEC, 7, 130), 30.0),
    (reading("a4", "up", 6 * SEC, 5 * SEC, 8), 8.0),
    (reading("a5", "up", 9 * SEC, 8 * SEC, 2), 2.0),
    (reading("a6", "up", 10 * SEC, 8 * SEC, 1), None),
    (reading("a7", "up", 11 * SEC, 8 * SEC, 1.5), None),
    (reading("a8", "up", 12 * SEC, 8 * SEC, 20), 18.0),
    (reading("b1", "late", 20 * SEC, 1, 3), None),
    (reading("c1", "free", 1 * SEC, 2, -1, False), None),
    (reading("c2", "free", 2 * SEC, 2, -6.5, False), -5.5),
    (reading("c3", "free", 3 * SEC, 2, 4, False), 10.5),
]


@pytest.mark.parametrize("parts", [None, 1, 5])
def test_differences(spark, parts):
    rows = O.difference_cumulative(records(spark, [r for r, _ in FIXTURE]), parts).collect()
    assert {r.id: r.value for r in rows} == {r["id"]: want for r, want in FIXTURE}
    assert sorted(r.id for r in rows if r.violation) == ["a6", "a7"]
    assert {r.id: r.cumulative_value for r in rows} == {r["id"]: r["value"] for r, _ in FIXTURE}


def test_other_records_pass(spark):
    delta = {**reading("d", "m", 1, 1, 3), "temporality": "delta"}
    lost = {**reading("l", None, 1, 1, 3)}
    rows = {r.id: r for r in O.difference_cumulative(records(spark, [delta, lost])).collect()}
    assert rows["d"].value == 3.0 and rows["l"].value is None and rows["l"].cumulative_value == 3.0


def replay(rows):
    """Deltas in arrival order with the last accepted reading per stream."""
    last, out = {}, {}
    for r in rows:
        prev, now = last.get(r["stream_id"]), (r["ts_nano"], r["start_nano"], r["value"])
        out[r["id"]] = None
        if prev and r["ts_nano"] <= prev[0]:
            continue
        if prev and r["start_nano"] != prev[1]:
            out[r["id"]] = r["value"]
        elif prev and r["monotonic"] and r["value"] < prev[2]:
            continue
        elif prev:
            out[r["id"]] = r["value"] - prev[2]
        last[r["stream_id"]] = now
    return out


def random_readings(seed, n=400):
    rng = random.Random(seed)
    times = [rng.randrange(1, n // 2) * 100 for _ in range(n)]  # many at one instant
    rows = [reading(f"r{i}", f"s{rng.choice('aaaabc')}", t * 1_000_000, 0, rng.randrange(50)) for i, t in enumerate(times)]
    for r in rows:
        r["monotonic"] = r["stream_id"] != "sb"
        r["start_nano"] = (r["ts_nano"] // 7_000_000_000) * rng.choice([1, 1, 1, 2])
    return sorted(rows, key=lambda r: (r["ts_nano"], r["start_nano"], r["id"]))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranges_match_a_replay(spark, parts):
    rows = random_readings(parts)
    got = {r.id: r.value for r in O.difference_cumulative(records(spark, rows), parts).collect()}
    assert got == replay(rows)


def test_a_reading_behind_a_violation_of_its_instant_counts(spark):
    rows = [reading(str(i), "s", t, 0, v) for i, (v, t) in enumerate([(10, 1), (5, 2), (12, 2), (15, 3), (40, 3)])]
    got = O.difference_cumulative(records(spark, rows)).collect()
    assert {r.id: r.value for r in got} == {"0": None, "1": None, "2": 2.0, "3": 3.0, "4": None}
    assert [r.id for r in got if r.violation] == ["1"]


def after_all(state, run):
    for r in run:
        state, _ = C.accept(state, *r)
    return state


def test_handover_of_every_value():
    rng = random.Random(4)
    for _ in range(400):
        monotonic = rng.random() < 0.8
        run = sorted((rng.randrange(4), rng.choice([1, 1, 1, 2]), float(rng.randrange(8)), monotonic) for _ in range(rng.randrange(1, 12)))
        run = [(t, s, rng.choice([v, v + 3]), m) for t, s, v, m in run]
        for cut in {0, len(run) // 2, len(run) - 1}:  # ranges begin within instants too
            hand = C.RangeStart.of(run[cut:])
            before = [after_all(None, run[:cut]), None]
            before += [(s, v / 2, t) for s in (1, 2, 3) for v in range(-1, 24) for t in (-1, run[cut][0])]
            for state in before:
                assert hand.after(state) == after_all(state, run[cut:])


def test_one_instant_is_spread_over_ranges(spark):
    """10,000 readings of one stream at one time: most fall below the value before, one is accepted."""
    order = random.Random(8).sample(range(10_000), 10_000)
    rows = [reading("first", "s", 1, 0, 9_990)] + [reading(f"r{i:05}", "s", 2, 0, v) for i, v in enumerate(order)] + [reading("z", "s", 3, 0, 20_000)]
    made = O.difference_cumulative(records(spark, rows), 8).cache()
    taken = next(i for i, v in enumerate(order) if v >= 9_990)
    got = {r.id: (r.value, r.violation) for r in made.select("id", "value", "violation").collect()}
    assert got["z"] == (20_000.0 - order[taken], False) and got[f"r{taken:05}"] == (order[taken] - 9_990.0, False)
    assert all(got[f"r{i:05}"] == (None, i < taken) for i in range(10_000) if i != taken)
    bounds = made.sparkSession.createDataFrame([(f"r{i:05}",) for i in range(10_000)], "id string")
    keys = bounds.selectExpr("'s' AS _stream", "2 AS ts_nano", "0 AS _start", "struct(id) AS _order")
    spread = keys.repartitionByRange(8, "_stream", "ts_nano", "_start", "_order").selectExpr("spark_partition_id() AS p").groupBy("p").count()
    assert max(r["count"] for r in spread.collect()) < 3_000


def test_batches_with_state_match_a_replay(spark):
    rows = random_readings(11, 120)
    late = [rows.pop(i) for i in (100, 60, 30)]
    batches = [rows[:50], rows[50:90] + late[2:], rows[90:] + late[:2]]
    batches = [sorted(b, key=lambda r: (r["ts_nano"], r["start_nano"], r["id"])) for b in batches]
    state, got = None, {}
    for batch in batches:
        out, state = O.difference_batch(records(spark, batch), state, parts=3)
        got.update({r.id: r.value for r in out.collect()})
        state = spark.createDataFrame(state.collect(), state.schema)
    assert got == replay([r for b in batches for r in b])


def test_dedupe_keeps_the_earliest_and_all_without_id(spark):
    rows = [{"project_id": 1, "id": i, "signal": "log", "source": s, "source_id": k, "received_at_ms": t, "ts_nano": 0}
            for i, s, k, t in (("a", "x", "k", 2), ("b", "x", "k", 1), ("c", "y", "k", 3), ("d", "x", None, 1), ("e", "x", None, 1))]
    df = records(spark, rows)
    out = O.dedupe(df)
    assert {r.id for r in out.collect()} == {"b", "c", "d", "e"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # copies are dropped before the shuffle


def oldest(rows, target, other=0):
    total, gone = sum(r[3] for r in rows) + other, set()
    for ms, id, project, size in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if total <= target:
            break
        gone.add((id, project))
        total -= size
    return gone


@pytest.mark.parametrize("share", [0.05, 0.5, 0.95, 2.0])
def test_hot_eviction(spark, share):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, rng.randrange(10**10)]), f"id{rng.randrange(10**6):06d}{i}", i % 3, rng.randrange(1, 90))
            for i in range(400)]
    df = spark.createDataFrame(rows, "received_at_ms bigint, id string, project_id bigint, logical_bytes bigint").cache()
    target = max(int(sum(r[3] for r in rows) * share), 1)
    cut = O.hot_cut(df, target, other_bytes=100)
    got = {(r.id, r.project_id) for r in df.filter(cut.evicted()).collect()} if cut else set()
    assert got == oldest(rows, target, 100)
    if share == 0.5:
        assert O.evict_hot(df, target, 100).count() == len(got)


def test_plan_evicts_only_the_oldest(spark):
    plan = spark.createDataFrame(
        [(1, "log", "1970-01-01", 1_000, 60), (2, "log", "1970-01-01", 2_000, 70)],
        "project_id bigint, signal string, receive_date string, min_received_ms bigint, logical_bytes bigint")
    assert [r.project_id for r in O.evict_plan(plan, 130 - 60).collect()] == [1]
    assert O.evict_plan(plan, 130).count() == 0 and O.evict_plan(plan, 69).count() == 2
    assert O.evict_plan(plan, 130, other_bytes=1).count() == 1
    with pytest.raises(ValueError):
        O.evict_plan(plan, 0)


def error(project, id, ts, fingerprint, title="Boom", level=None, **more):
    return {"project_id": project, "id": id, "signal": "error", "source": "sentry", "source_id": id, "ts_nano": ts * 1_000_000,
            "received_at_ms": ts, "issue_fingerprint": fingerprint, "issue_title": title, "level": level, **more}


ERRORS = [error(1, "a", 10, "run", "first", "fatal"), error(1, "b", 30, "run", "last", "info"), error(1, "c", 20, "other"),
          error(1, "d", 5, "explicit"), error(2, "e", 1, "run")]


def test_issue_rollup(spark):
    errors = I.with_issue_id(records(spark, ERRORS))
    rows = I.issues(errors).collect()
    assert sorted((r.project_id, r.total_seen) for r in rows) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    run = next(r for r in rows if r.project_id == 1 and r.total_seen == 2)
    assert (run.title, run.level, run.first_seen_ms, run.last_seen_ms, run.latest_record_id) == ("last", "fatal", 10, 30, "b")
    assert len({r.issue_id for r in rows}) == 3  # equal fingerprints share an id across projects


def test_retained_after_eviction(spark):
    errors = I.with_issue_id(records(spark, ERRORS))
    table = I.issues(errors)
    kept = errors.filter("id not in ('b', 'c')")
    rows = {(r.project_id, r.total_seen, r.retained_events, r.latest_record_id) for r in I.retained(table, kept).collect()}
    assert rows == {(1, 2, 1, None), (1, 1, 0, None), (1, 1, 1, "d"), (2, 1, 1, "e")}


def test_title_stands_in_for_a_fingerprint(spark):
    df = I.with_issue_id(records(spark, [error(1, "a", 1, None, "T"), error(1, "b", 1, "T", "x"), error(1, "c", 1, None, None)]))
    ids = {r.id: r.issue_id for r in df.collect()}
    assert ids["a"] == ids["b"] != ids["c"]
    import uuid

    space = uuid.UUID("584b5a7e983f47f08de1f9483dd695b7")
    assert ids["a"] == uuid.uuid5(space, "T").hex and ids["c"] == uuid.uuid5(space, "Error").hex
