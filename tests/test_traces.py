"""Trace trees against a plain walk, including orphans, cycles, chains and stars."""

import random

import pytest

from signaldeck.operators.traces import trace_tree

SCHEMA = "project_id bigint, trace_id string, id string, ts_nano bigint, span_id string, parent_span_id string"


def walk(rows):
    """(id, depth) in order, by a direct depth-first walk of one trace."""
    unique = {r[2]: r for r in rows}
    by_time = sorted(unique.values(), key=lambda r: (r[3], r[2]))
    spans = {r[4] for r in by_time}
    children = {}
    for r in by_time:
        children.setdefault(r[5] if r[5] in spans else None, []).append(r)
    out, seen = [], set()
    for start in children.get(None, []) + by_time:
        stack = [(start, 0)]
        while stack:
            row, depth = stack.pop()
            if row[2] in seen:
                continue
            seen.add(row[2])
            out.append((row[2], depth))
            stack.extend((child, depth + 1) for child in reversed(children.get(row[4], [])))
    return out


def tree(spark, rows):
    found = trace_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    result = {}
    for r in sorted(found, key=lambda r: (r.trace_id, r.position)):
        result.setdefault(r.trace_id, []).append((r.id, r.depth))
    assert all(
        sorted(r.position for r in found if r.trace_id == t) == list(range(len(rs))) for t, rs in result.items()
    )
    return result


MIXED = [
    (1, "t", "late", 30, "c", "a"), (1, "t", "root", 10, "a", None), (1, "t", "early", 20, "b", "a"),
    (1, "t", "grandchild", 25, "d", "b"), (1, "t", "orphan", 5, "e", "missing"),
    (1, "t", "cycle-b", 50, "g", "f"), (1, "t", "cycle-a", 40, "f", "g"), (1, "t", "early", 20, "b", "a"),
]


@pytest.fixture(params=["one", "many"])
def ranges(request, spark):
    """With few partitions, and with many that cut through every trace."""
    if request.param == "many":
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_orphans_cycles_and_repeats(spark, ranges):
    assert tree(spark, MIXED)["t"] == [
        ("orphan", 0), ("root", 0), ("early", 1), ("grandchild", 2), ("late", 1), ("cycle-a", 0), ("cycle-b", 1),
    ]


def random_trace(rng, name, size, loops):
    rows = []
    for i in range(size):
        parent = rng.choice([None, "gone"] if i == 0 else [f"s{rng.randrange(i)}", f"s{i - 1}", None])
        if loops and rng.random() < 0.2:
            parent = f"s{rng.randrange(size)}"
        rows.append((1, name, f"{name}-{rng.randrange(10**6):06d}-{i}", rng.randrange(20), f"s{i}", parent))
    rng.shuffle(rows)
    return rows


def test_random_forests(spark, ranges):
    rng = random.Random(7)
    traces = {f"t{i}": random_trace(rng, f"t{i}", rng.randrange(1, 40), i % 2) for i in range(30)}
    traces["star"] = [(1, "star", "r", 0, "r", None)] + [(1, "star", f"c{i}", i % 50, f"c{i}", "r") for i in range(300)]
    traces["chain"] = [(1, "chain", f"n{i}", 500 - i, f"n{i}", f"n{i - 1}" if i else None) for i in range(200)]
    found = tree(spark, [row for rows in traces.values() for row in rows])
    assert found == {name: walk(rows) for name, rows in traces.items()}
