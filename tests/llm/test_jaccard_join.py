import brute
import numpy as np
import pytest
from texts import body

from signaldeck.llm import jaccard_join
from signaldeck.llm.components import components


def prefix(*tokens):
    return np.array(tokens, np.int64).tobytes()


def test_frequent_shingles_alone_unite_only_groups_that_have_enough_of_them(spark):
    take, common = jaccard_join.needed(500, 90)
    own = lambda i, n: range(1000 * i, 1000 * i + n)
    few = [(i, 500, prefix(*range(3), *own(i, take - 3))) for i in range(10, 50)]
    # Of one pair, the shingles that must be shared are partly frequent ones.
    few += [(i, 500, prefix(*range(3), *own(60, common - 3), *own(i, take - common))) for i in (61, 62)]
    many = [(i, 500, prefix(*range(100, 100 + common), *own(i, take - common))) for i in range(70, 110)]
    groups = spark.createDataFrame(few + many, "gid bigint, n bigint, prefix binary")
    edges = [(r.a, r.b) for r in jaccard_join.group_pairs(groups, 90).collect()]
    assert [e for e in edges if max(e) < 70] == [(61, 62)]
    of = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {of[i] for i in range(70, 110)} == {70}


@pytest.mark.parametrize(("shingle", "percent", "bits"), [(3, 90, 20), (5, 80, 22)])
def test_classes_of_texts_with_frequent_lines(spark, monkeypatch, shingle, percent, bits):
    lines = [f"a common line number {i} that stands in many of the texts here" for i in range(9)]
    texts, rng = {}, np.random.default_rng(3)
    for i in range(150):
        words = body(int(rng.integers(0, 30)), int(rng.integers(5, 140))).split()
        for k in rng.integers(0, len(words), int(rng.integers(0, 4))):
            words[k] = f"edit{k}"
        texts[i] = "\n".join([*(lines[k] for k in rng.permutation(9)[: rng.integers(0, 10)]), " ".join(words)])
        texts[i + 150] = texts[i] + " more" * int(rng.integers(0, 3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    want = brute.shingle_classes(texts, shingle, percent)
    assert len({c for _, c in want.values()}) < len(texts) - 100
    monkeypatch.setattr(jaccard_join, "ORDER_BITS", range(bits, bits + 1))
    got = {r.doc: (r.n_shingles, r.component) for r in jaccard_join.similar_classes(docs, shingle, percent).collect()}
    assert got == want


def test_buckets_grow_with_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a" * 3_000_000), (2, None)], "doc bigint, text string")
    assert jaccard_join.order_bits(docs) == 20
    monkeypatch.setattr(jaccard_join, "BUCKET_TEXT", 1)
    assert jaccard_join.order_bits(docs) == 22
    assert len(jaccard_join.shingle_order(docs, 3)) == 1 << 22


def test_texts_of_likely_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)] + [(7, "again"), (None, "no id")], "doc bigint, text string")
    ids = spark.range(0, 4000, 10).union(spark.createDataFrame([(7,), (-5,)], "id bigint"))
    got = [(r.doc, r.text) for r in jaccard_join.likely(docs, ids).collect()]
    assert {(i, f"text {i}") for i in range(0, 4000, 10)} | {(7, "text 7"), (7, "again")} <= set(got)
    assert len(got) == len(set(got)) < 900
    assert jaccard_join.likely(docs, ids.limit(0)).count() == 0
