"""Every text query on a table of odd cases, on an empty table, and on repeated rows."""

from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check_oracle import compare
from signaldeck.llm.catalog import ORACLES, QUERIES
from signaldeck.llm.decontamination import fold_words


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", ["op2_line_dedup", "op10_quality_rules"])
def test_oracle_on_odd_cases(spark, odd_dir, duck, name):
    got = QUERIES[name](spark, odd_dir).toPandas()
    assert compare(got, duck(odd_dir, "documents").execute(ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_on_given_tables(spark, name):
    folder, connection = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert compare(QUERIES[name](spark, folder).toPandas(), connection.execute(ORACLES[name]).df()) == "ok"


def test_packing(spark, odd_dir, odd, tokenizer):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows(spark, "op1_packing", odd_dir):
        pieces[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    assert set(pieces) == set(odd)
    for i, own in pieces.items():
        ids, at = tokenizer.encode(odd[i] or "", add_special_tokens=False).ids + [2], 0
        for x in sorted(own, key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), brute.crc(ids[at : at + x.length]))
            at += x.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or cut at a power of two


def test_line_dedup(spark, odd_dir, odd):
    want = brute.lines(odd)
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_sha256) for x in rows(spark, "op2_line_dedup", odd_dir)}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in want.items()}


def test_scores_are_probabilities(spark, odd_dir, odd):
    got = rows(spark, "op3_quality_classifier", odd_dir)
    assert {x.doc_id for x in got} == set(odd)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)


def test_jaccard_join(spark, odd_dir, odd):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in rows(spark, "op4_jaccard_join", odd_dir)}
    assert got == brute.shingle_classes(odd)


def test_token_counts(spark, odd_dir, odd, tokenizer):
    got = {x.doc_id: (x.n_bytes, x.n_tokens, x.over_limit) for x in rows(spark, "op5_token_counts", odd_dir)}
    for i, text in odd.items():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 2048)


def test_token_files(spark, odd_dir, odd, tokenizer):
    got, at = {x.doc_id: x for x in rows(spark, "op6_token_files", odd_dir)}, 0
    for i in sorted(odd):
        ids = tokenizer.encode(odd[i] or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)


def test_decontamination(spark, odd_dir, odd):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").collect() if r.item_id is not None]
    want = brute.contamination(odd, items)
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in rows(spark, "op7_decontamination", odd_dir)}
    assert got == {i: (n, h, len(f), brute.sha(",".join(f)), h > 0) for i, (n, h, f) in want.items()}
    assert any(x[4] for x in got.values())


def test_substring_dedup(spark, odd_dir, odd):
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in rows(spark, "op8_substring_dedup", odd_dir)}
    assert got == {i: (n, g, brute.sha(t)) for i, (n, g, t) in brute.repeated_words(odd).items()}


def test_rows_that_repeat_an_id_or_have_none(spark, tmp_path_factory):
    from texts import body, write_documents

    folder = tmp_path_factory.mktemp("repeated")
    table = [(1, body(1)), (1, body(1)), (None, body(1)), (None, None), (2, body(2)), (2, body(3)), (3, body(3))]
    write_documents(spark, folder, table)
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name in QUERIES:
        if name not in ("op1_packing", "op9_html_extraction", "op11_vector_codes"):
            assert len(rows(spark, name, str(folder))) == len(table), name
    kept = {x.doc_id: x.n_removed for x in rows(spark, "op8_substring_dedup", str(folder))}
    assert kept[1] == kept[None] == 0 and kept[3] == 60


def test_pipeline_stages(spark, odd_dir, odd, duck):
    from signaldeck.llm.quality_rules import JUDGED_SQL

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, odd_dir)
    assert one.columns == docs.columns
    sql = "WITH docs_in AS (SELECT doc_id, text, source FROM documents), " + JUDGED_SQL + "SELECT doc_id, kept_text FROM judged WHERE kept"
    assert text(one) == dict(duck(odd_dir, "documents").execute(sql).fetchall())
    two = stage["line_dedup"](spark, docs, odd_dir)
    assert text(two) == {i: t for i, (_, _, t) in brute.lines(odd).items()}
    three = stage["jaccard_join"](spark, docs, odd_dir)
    classes = brute.shingle_classes(odd, 5, 80)
    assert text(three) == {i: t for i, t in odd.items() if classes[i][1] == i}
    four = text(stage["decontamination"](spark, docs, odd_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{odd_dir}/benchmark.parquet").collect() if r.item_id is not None]
    found = brute.contamination(odd, items)
    assert set(four) == {i for i, (n, h, _) in found.items() if 2 * h <= n}
    for i, t in four.items():
        n, h, _ = found[i]
        assert len(fold_words((t or "").encode())) == n - h
        assert h or (t or "") == (odd[i] or "")
    assert corpus_pipeline.run(spark, odd_dir).count() > 0


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [x for x in rows(spark, "op3_quality_classifier", folder) if x.held_out and x.doc_id in labels]
    truth, score = np.array([labels[x.doc_id] for x in got]), np.array([x.score for x in got])
    good, bad = score[truth == 1], score[truth == 0]
    assert np.mean(good[:, None] > bad[None, :]) > 0.9
    assert np.mean((score >= 0.3) == truth) > 0.9
