"""Vector codes against a plain version."""

import math
from collections import defaultdict

import brute
import numpy as np
import pytest

from signaldeck.llm import vector_codes as vc
from signaldeck.llm.catalog import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, codes string, error string"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of all kept rows, and the checksum."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[[math.floor(4096 * x) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((away(own[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for own in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            members = defaultdict(list)
            for own, at in zip(cut, near, strict=True):
                members[at[p][1]].append(own[p])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    near, by_label = assign(), defaultdict(int)
    errors = [sum(d for d, _ in at) for at in near]
    for r, error in zip(kept, errors, strict=True):
        by_label[r[2]] += error
    sha = brute.sha(",".join(str(x) for p in books for c in p for x in c))
    return [(r[0], "".join(f"{e:02x}" for _, e in at), error, by_label[r[2]]) for r, at, error in zip(kept, near, errors, strict=True)], sha


def written(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def odd_rows():
    rng = np.random.default_rng(3)
    vector = lambda: rng.normal(0, 0.3, 16).astype(np.float32).tolist()
    rows = [(i, vector(), i % 3 or None) for i in range(10, 90)]
    hot = vector()
    rows += [(100 + i, hot, 7) for i in range(60)]
    rows += [(15, vector(), 1), (12, rows[2][1], 2), (12, rows[2][1], 2), (None, vector(), None), (None, hot, 1)]
    rows += [(1, None, 1), (2, [math.nan, *vector()[1:]], 1), (3, [*vector()[:15], math.inf], 2), (4, [None, *vector()[1:]], 2), (5, [-1000.0] * 16, 4)]
    return rows


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("some", [slice(None), slice(0, 9)])
def test_odd_rows(spark, tmp_path, some):
    rows = odd_rows()[some]
    got = QUERIES["op11_vector_codes"](spark, written(spark, tmp_path, rows)).collect()
    want, sha = plain(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_only_rows_that_are_dropped(spark, tmp_path):
    assert QUERIES["op11_vector_codes"](spark, written(spark, tmp_path, [(1, None, 1), (2, [math.nan] * 8, 1)])).collect() == []


def test_vectors_that_do_not_fit_are_errors(spark):
    table = lambda *vs: spark.createDataFrame([(i, v, 1) for i, v in enumerate(vs)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(ValueError):
        vc.vector_codes(table([0.5] * 9))
    with pytest.raises(Exception, match="expected to have 16"):
        vc.vector_codes(table([0.5] * 16, [0.5] * 8))


def test_members_are_added_up_where_they_lie(spark, tmp_path):
    rows = [(i, 8 * 16 + i, [i]) for i in range(100)]
    df = spark.createDataFrame(rows, "row int, owner int, part array<int>")
    held = vc._Members(spark, 4)
    members = held.save(df.repartition(4, "owner"))
    summed = members.groupBy("owner").agg({"row": "sum"})
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    held.drop()
