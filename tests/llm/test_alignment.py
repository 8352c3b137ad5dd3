"""Token alignment against a plain version."""

from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from signaldeck.llm import token_alignment as ta

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    None, "", " ", "\n", "  two  spaces \n\n after\tand before ", "a\r\nb\r\n{\r\n}", "x   y z", "　wide \x1c!\x1c ?",
    "<|endoftext|> <s> <0x41> </s>", "under▁score and ▁", "\x00 nul", "ﬁne naïve \U0001f600\U0001f600 ไทย 中文", "a" * 5000,
    "don't we'll  I'd 12345 1,000.5 ...!!??", "tail \x0b\x0c", "\n\n\nlines\n \n",
]


def plain(texts):
    """One (n_a, n_b, groups, links) by text, libraries called on whole texts."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte_of = {}
    for i, letter in enumerate([*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]):
        byte_of[chr(letter)] = letter
    byte_of |= {chr(0x100 + k): x for k, x in enumerate(x for x in range(256) if x not in byte_of.values())}
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, "", []))
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xa = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            out.append((0, 0, "", []))
            continue
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (xa, xb)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for end in common:
            p, q = i, j
            while i < len(ia) and ends[0][i] <= end:
                i += 1
            while j < len(ib) and ends[1][j] <= end:
                j += 1
            groups.append(",".join(map(str, ia[p:i])) + "|" + ",".join(map(str, ib[q:j])))
            for k in range(p, i):
                for m in range(q, j):
                    if max(ends[0][k] - len(xa[k]), ends[1][m] - len(xb[m])) < min(ends[0][k], ends[1][m]):
                        links.append((ia[k], ib[m]))
        out.append((len(ia), len(ib), ";".join(groups), links))
    return out


def expected(texts):
    got = plain(texts)
    held = Counter(pair for *_, links in got for pair in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(held[p] == best[p[0]] for p in links),
         sum(held[p] for p in links), brute.sha(groups) if groups else "")
        for n_a, n_b, groups, links in got
    ]


def rows_of(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("table_pairs", [0, 40, ta.TABLE_PAIRS])
def test_odd_texts(spark, table_pairs):
    texts = [*ODD, ODD[4], ODD[11]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = rows_of(ta.alignment_report(docs, *PATHS, table_pairs=table_pairs))
    assert got == dict(enumerate(expected(texts)))


def test_query_on_odd_table(spark, odd_dir, odd):
    from signaldeck.llm.catalog import QUERIES

    assert rows_of(QUERIES["op12_token_alignment"](spark, odd_dir)) == dict(zip(odd, expected(odd.values()), strict=True))


def test_groups_tile_the_tokens(spark):
    docs = spark.createDataFrame([(1, "some plain words"), (2, None)], "doc_id bigint, text string")
    for row in ta.align(docs, *PATHS).collect():
        for ids, ends in ((row.a_ids, row.a_ends), (row.b_ids, row.b_ends)):
            ids, ends = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u4")
            assert (len(ids) == 0) == (row.doc_id == 2) and (np.diff(ends) > 0).all() and (not len(ids) or ends[-1] == len(ids))


def test_shared_cuts_find_every_common_end():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 10, 500):
        for share in (0.02, 0.3, 0.9):
            last = size + 1
            a, b = (np.append(np.flatnonzero(rng.random(size) < share) + 1, last) for _ in "ab")
            a_cuts, b_cuts = ta.shared_cuts(a, b, np.array([[0], [len(a)]]), np.array([[0], [len(b)]]))
            common = np.intersect1d(a, b)
            assert (a[a_cuts - 1] == common).all() and (b[b_cuts - 1] == common).all()


def held(own, texts):
    got = own.align([t.encode() for t in texts])
    return [g.decode() for g in own.groups(got)], [got.sums(p.sizes(got.slots)).tolist() for p in (own.a, own.b, own.a_ends, own.pairs)]


def wanted(texts):
    n_a, n_b, groups, links = zip(*plain(texts), strict=True)
    return list(groups), [list(n_a), list(n_b), [g.count(";") + bool(g) for g in groups], list(map(len, links))]


def test_a_stretch_is_encoded_and_aligned_once(monkeypatch):
    own, spans, calls, whole = ta.Aligner(*PATHS), [], [], ta.shared_cuts
    monkeypatch.setattr(ta, "shared_cuts", lambda a, b, x, y: spans.append(x.shape[1]) or whole(a, b, x, y))
    encode = own._sides[0].encode
    monkeypatch.setattr(own._sides[0], "encode", lambda texts: calls.append(len(texts)) or encode(texts))
    texts = ["one two three four five six seven"] * 3 + ["seven two one\neight"] * 2
    for _ in range(2):
        assert held(own, texts) == wanted(texts)
    # one ... seven and "\neight", at most JOINED of them in a call's text.
    assert spans == [8] and calls == [1]


def test_stretches_of_several_chunks_are_kept(monkeypatch):
    own, learned = ta.Aligner(*PATHS, capacity=60), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda fresh: learned.extend(fresh) or learn(fresh))
    for i in range(60):
        texts = [f"often used w{i} v{i}", *ODD[4:6]]
        assert held(own, texts) == wanted(texts)
    assert len(own._slots) < 70 and learned.count(" often") == 1


def test_a_stretch_that_is_not_reproduced_spoils_its_texts_alone(monkeypatch):
    own = ta.Aligner(*PATHS)
    side = own._sides[1]
    encode, other = side.encode, side.encode(["?"])[0]
    monkeypatch.setattr(side, "encode", lambda texts: [other if "bad" in t else ids for t, ids in zip(texts, encode(texts), strict=True)])
    texts = ["some good words", "some bad words", "", "some good\nwords, more \n", *ODD[4:12]]
    groups, sizes = wanted(texts)
    groups[1] = ""
    for column in sizes:
        column[1] = 0
    for _ in range(2):
        assert held(own, texts) == (groups, sizes)


def test_a_text_may_be_reproduced_though_its_stretches_are_not(monkeypatch):
    own = ta.Aligner(*PATHS)
    side = own._sides[1]
    encode = side.encode
    # The edge between two stretches of this side lies a byte further.
    moved = {" left": " left ", " right": "right"}
    monkeypatch.setattr(side, "encode", lambda texts: encode([moved.get(t, t + "!" * (t in (" left right",))) for t in texts]))
    got = own.align([b"left right", b"up"])
    whole = own.groups(got)
    assert whole[1].decode() == plain(["up"])[0][2] and whole[0].count(b";") < 2 and b"|" in whole[0]
    a, b = own.a.take(got.slots), own.b.take(got.slots)
    joined = [b"".join(s.bytes_of[i] for i in ids) for s, ids in zip(own._sides, (a, b), strict=True)]
    assert joined == [b" left right up"] * 2


def test_align_numbers_ends_from_each_text(spark):
    texts = [t for t in ODD if t] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = {r.doc_id: r for r in ta.align(docs, *PATHS).collect()}
    for i, (_, _, groups, _) in enumerate(plain(texts)):
        a, b, a_ends, b_ends = (np.frombuffer(rows[i][c], "<u4").tolist() for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
        spans = zip([0, *a_ends][:-1], a_ends, [0, *b_ends][:-1], b_ends, strict=True)
        assert ";".join(",".join(map(str, a[p:q])) + "|" + ",".join(map(str, b[r:s])) for p, q, r, s in spans) == groups
