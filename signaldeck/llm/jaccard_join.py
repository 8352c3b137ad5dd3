"""Jaccard self-join on word shingles by grouped prefixes.

1. Shingles are ordered by how often their bucket of hashes occurs in the whole corpus,
   rarest first; the more text, the more buckets.  Texts as similar as asked share several
   of their first shingles in this order: a text's *prefix*.
2. Documents with the same prefix and size are one *group*; exact copies vanish in it.
3. Group pairs come from the prefix shingles they share.  A shingle of few groups gives
   their pairs of fitting sizes, and pairs that share too few shingles are dropped.  A
   frequent shingle may be one of the shared ones, but only where a group has enough of them
   to be similar by these alone are its groups chained by size, each to the next, so that no
   list of pairs is written for it.
4. The groups that hang together by these pairs are expanded into their distinct members
   and verified exactly, unit by unit.  A unit that is too large for a task is cut into
   blocks, and every pair of blocks is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from signaldeck.llm.common import chunks, narrow, tables, tidied
from signaldeck.llm.components import components
from signaldeck.llm.substring_dedup import WORD_HASHES, mix, sequence_hashes

SHINGLE = 3
PERCENT = 90
#: Buckets of shingle hashes whose counts give the order, as powers of two, and bytes of text for one.
ORDER_BITS = range(20, 25)
BUCKET_TEXT = 800
#: Groups of a shingle up to which pairs are listed.
LISTED = 16
#: Shingles and documents of a unit, or of one block of it, that a task verifies at once.
UNIT_SHINGLES = 2_000_000
UNIT_DOCS = 2_000
#: Bits of the table of likely ids for each of them, and the most in all and in one of its parts as powers of two.
ID_BITS = 16
TABLE_BITS = 28
ID_PART = 12
_PART = 1 << 14


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle, empty ones none."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter(map(WORD_HASHES.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    all_hashes, out, at = sequence_hashes(words, size), [], 0
    for n in sizes.tolist():
        if n >= size:
            own = np.sort(all_hashes[at : at + n - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(mix(sequence_hashes(words[at : at + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
        at += n
    return out


def needed(size: int, percent: int) -> tuple[int, int]:
    """Prefix length of a set, and how many shingles two prefixes must share.

    Of two sets similar enough, each shares ceil(percent * size / 100) of its shingles;
    so the first size - that + k of both share k.
    """
    plain = size - -(-percent * size // 100) + 1
    common = max(1, plain // 4)
    return min(size, plain + common - 1), common


def order_bits(docs: DataFrame) -> int:
    """Bits of a shingle's bucket: the more text, the more buckets, so that rare shingles still stand out."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max((size // BUCKET_TEXT).bit_length(), ORDER_BITS[0]), ORDER_BITS[-1])


def shingle_order(docs: DataFrame, shingle: int) -> np.ndarray:
    """Count of each bucket of shingle hashes over all documents (doc, text), as far as 16 bits hold it.

    A task counts to 255 at most.  Any counts give an order that all documents share.
    """
    bits = order_bits(docs)
    buckets = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.uint8)
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, shingle)
                if sets:
                    at, own = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                    total[at] = np.minimum(total[at] + own, 255)
        if total.any():
            parts = [pa.compress(total[i : i + _PART], "zstd", asbytes=True) for i in range(0, buckets, _PART)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(pa.decompress(counts, _PART, "zstd", asbytes=True), np.uint8)
                sums[part] = sums.get(part, 0) + own.astype(np.int64)
        held = [np.minimum(x, 0xFFFF).astype(np.uint16).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(held, pa.binary())], names=["part", "counts"])

    schema = "part bigint, counts binary"
    counted = docs.mapInArrow(tidied(count), schema).repartition("part").mapInArrow(tidied(add), schema)
    total = np.zeros(buckets, np.uint16)
    for row in counted.toLocalIterator():  # buckets / _PART rows
        total[row["part"] * _PART : (row["part"] + 1) * _PART] = np.frombuffer(row["counts"], np.uint16)
    return total


def sketches(docs: DataFrame, order: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(doc, n, s1, s2, g1, g2, prefix): size, 128-bit hashes of the set and of (prefix, size), and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    drop = np.uint64(64 - (len(order).bit_length() - 1))
    low = np.uint64((1 << 48) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                sizes, hashes, prefixes = [], [], []
                for s in shingle_sets(texts, shingle):
                    n = len(s)
                    prefix = b""
                    if n:
                        take, _ = needed(n, percent)
                        # The bucket's count before the hash: shingles in order.
                        keys = (counts[s >> drop].astype(np.uint64) << np.uint64(48)) | (s & low)
                        prefix = np.sort(np.partition(keys, take - 1)[:take]).tobytes()
                    sizes.append(n)
                    prefixes.append(prefix)
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()) + xxhash.xxh3_128_digest(prefix + n.to_bytes(8, "little")))
                sums = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 4)
                columns = [batch.column("doc")[rows], pa.array(sizes, pa.int64()), *(pa.array(sums[:, i]) for i in range(4)), pa.array(prefixes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "s1", "s2", "g1", "g2", "prefix"])

    kinds = [docs.schema["doc"], *(StructField(c, LongType()) for c in ("n", "s1", "s2", "g1", "g2")), StructField("prefix", BinaryType())]
    return docs.mapInArrow(tidied(run), StructType(kinds))


class TokenRuns:
    """Candidate pairs of the groups that share a prefix shingle, from rows in (shingle, size, group) order."""

    def __init__(self, percent: int) -> None:
        self._percent = percent
        self._rows = [np.zeros(0, np.int64) for _ in range(3)]
        self._hot = False  # the first row continues a frequent shingle
        #: Rows of frequent shingles among those added last.
        self.frequent = tuple(self._rows)

    def add(self, tokens: np.ndarray, sizes: np.ndarray, groups: np.ndarray, last: bool = False) -> tuple[np.ndarray, ...]:
        """(a, b, k): pairs and the shingles they must share, 0 for the links of a chain."""
        t, n, g = (np.concatenate(x) for x in zip(self._rows, (tokens, sizes, groups), strict=True))
        if not len(t):
            self.frequent = (t, n, g)
            return t, n, g
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(t)]]))
        hot = lengths > LISTED
        hot[0] |= self._hot
        new = np.repeat(hot, lengths)
        new[0] &= not self._hot
        self.frequent = (t[new], n[new], g[new])
        # The last shingle may go on: it waits, and of a frequent one only the end does.
        waits = 0 if last else int(lengths[-1])
        carry_hot = not last and bool(hot[-1])
        self._hot = carry_hot
        keep = slice(len(t) - (1 if carry_hot else waits), len(t)) if not last else slice(len(t), len(t))
        self._rows = [x[keep] for x in (t, n, g)]
        done = len(t) if last or carry_hot else len(t) - waits
        of_hot = np.repeat(hot, lengths)
        common = np.array([needed(int(x), self._percent)[1] for x in np.unique(n)]) if len(n) else n
        k = common[np.searchsorted(np.unique(n), n)] if len(n) else n
        a, b, ks = [], [], []
        for gap in range(1, LISTED):
            if done <= gap:
                break
            fits = (t[gap:done] == t[: done - gap]) & (100 * n[: done - gap] >= self._percent * n[gap:done])
            fits &= ~of_hot[: done - gap] | (gap == 1)
            at = np.flatnonzero(fits)
            a.append(g[at])
            b.append(g[at + gap])
            ks.append(np.where(of_hot[at], 0, np.minimum(k[at], k[at + gap])))
        if not a:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(a), np.concatenate(b), np.concatenate(ks)


def token_pairs(rows: DataFrame, percent: int, chained: bool) -> DataFrame:
    """(a, b, k) of the groups that share a shingle, from rows (token, n, gid).

    The groups of a frequent shingle are chained (k is 0), or else come back as (group, shingle, -size).
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = TokenRuns(percent)

        def out(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
            links = k == 0
            low, high = np.minimum(a, b), np.maximum(a, b)
            if chained and links.any():  # the same links come with every shingle of a cluster
                ends = np.unique(np.stack([low[links], high[links]]), axis=1)
            else:
                tokens, sizes, groups = runs.frequent
                ends = np.zeros((2, 0), np.int64) if chained else np.stack([groups, tokens])
            of_ends = np.zeros(ends.shape[1], np.int64) if chained else -sizes
            low, high = np.concatenate([low[~links], ends[0]]), np.concatenate([high[~links], ends[1]])
            k = np.concatenate([k[~links], of_ends])
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(k)], names=["a", "b", "k"])

        for batch in batches:
            yield from out(*runs.add(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)))
        yield from out(*runs.add(*[np.zeros(0, np.int64)] * 3, last=True))

    rows = rows.select("token", "n", "gid").repartition("token").sortWithinPartitions("token", "n", "gid")
    return rows.mapInArrow(tidied(pair), "a bigint, b bigint, k bigint")


def group_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the groups (gid, n, prefix) that may have similar members.

    Of the k shingles that two prefixes must share, no more are frequent than either has of
    them; the others are counted in their pairs.  Only *open* groups, with as many frequent
    shingles as the least k of any partner, can be similar by these alone: their pairs and
    chains come from the frequent shingles.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                prefixes = part.column("prefix").to_pylist()
                counts = np.fromiter(map(len, prefixes), np.int64, len(prefixes)) // 8
                rows = pa.array(np.repeat(np.arange(len(prefixes)), counts))
                tokens = pa.array(np.frombuffer(b"".join(prefixes), np.int64))
                yield pa.RecordBatch.from_arrays([tokens, part.column("n").take(rows), part.column("gid").take(rows)], names=["token", "n", "gid"])

    written = tables(groups.sparkSession)
    rows = groups.select("gid", "n", "prefix").mapInArrow(tidied(explode), "token bigint, n bigint, gid bigint")
    found = written.save(token_pairs(rows, percent, chained=False))
    frequent = found.where("k < 0").select(F.col("b").alias("token"), (-F.col("k")).alias("n"), F.col("a").alias("gid"))
    # needed() of the smallest partner.
    least = F.expr(f"least_n - (({percent} * least_n + 99) div 100) + 1") / 4
    held = frequent.groupBy(F.col("gid").alias("of")).agg(F.count("*").alias("held"), F.min("n").alias("n")).selectExpr("of", "held", f"({percent} * n + 99) div 100 AS least_n")
    held = written.save(held.select("of", "held", (F.col("held") >= F.greatest(F.lit(1), F.floor(least))).alias("open")))
    again = token_pairs(frequent.join(held.where("open"), F.col("gid") == F.col("of")), percent, chained=True)
    pairs = found.where("k > 0").union(again).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("k").alias("k"))
    side = lambda c: held.select(F.col("of").alias(f"{c}_of"), F.col("held").alias(f"{c}_held"), F.col("open").alias(f"{c}_open"))
    pairs = pairs.join(side("a"), F.col("a") == F.col("a_of"), "left").join(side("b"), F.col("b") == F.col("b_of"), "left")
    uncounted = F.when(F.col("a_open") & F.col("b_open"), 0).otherwise(F.least(F.coalesce("a_held", F.lit(0)), F.coalesce("b_held", F.lit(0))))
    return written.save(pairs.where(F.col("shared") >= F.col("k") - uncounted).select("a", "b"))


def verified(sets: list[np.ndarray], percent: int, across: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between similar sets that connect what is connected: a forest, as pairs of positions.

    With ``across``, the block of each set, only pairs of different blocks are looked at.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    flat = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.uint64)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = np.split(rank[inverse], np.cumsum([len(sets[i]) for i in order])[:-1]) if order else []
    single = np.sort(counts) == 1
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    postings: dict[int, list[int]] = {}
    mark = np.zeros(len(counts), bool)
    links = []
    for x, own in enumerate(ranks):
        n = len(own)
        if not n:
            continue
        plain = n - -(-percent * n // 100) + 1
        prefix = np.sort(np.partition(own, plain - 1)[:plain])
        prefix = prefix[~single[prefix]].tolist()
        seen = set(chain.from_iterable(postings.get(t, ()) for t in prefix))
        mark[own] = True
        mine = root(x)
        for y in sorted(seen, reverse=True):
            if 100 * len(ranks[y]) < percent * n or (across is not None and across[order[x]] == across[order[y]]):
                continue
            other = root(y)
            if other == mine:
                continue
            both = int(np.count_nonzero(mark[ranks[y]]))
            if 100 * both >= percent * (n + len(ranks[y]) - both):
                links.append((order[x], order[y]))
                parent[other] = mine
        mark[own] = False
        for t in prefix:
            postings.setdefault(t, []).append(x)
    return links


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc, text) whose doc is among the ids (id), and few others: a table of bits tells."""
    bits = min(max((ids.count() * ID_BITS).bit_length(), ID_PART + 5), TABLE_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("place").to_numpy()
            for part in np.unique(at >> ID_PART).tolist():
                parts.setdefault(part, np.zeros(1 << ID_PART, bool))[at[at >> ID_PART == part] & ((1 << ID_PART) - 1)] = True
        held = [np.packbits(x).tobytes() for x in parts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(held, pa.binary())], names=["part", "bits"])

    places = ids.select(place("id").alias("place")).withColumn("part", F.shiftright("place", ID_PART)).repartition("part").select("place")
    table, width = np.zeros(1 << (bits - 3), np.uint8), 1 << (ID_PART - 3)
    for row in places.mapInArrow(tidied(fill), "part bigint, bits binary").toLocalIterator():
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            held = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield batch.select(["doc", "text"]).filter(pa.array(held.astype(bool)))

    return docs.select("doc", "text", place("doc").alias("place")).mapInArrow(tidied(run), docs.select("doc", "text").schema)


def verify_units(docs: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between the similar documents of each unit; members are (id, n, unit)."""
    written = tables(docs.sparkSession)
    sizes = members.groupBy(F.col("unit").alias("u")).agg(F.sum("n").alias("shingles"), F.count("*").alias("docs"))
    blocks = F.greatest(F.ceil(F.col("shingles") / UNIT_SHINGLES), F.ceil(F.col("docs") / UNIT_DOCS)).cast("int")
    placed = members.join(sizes.select("u", blocks.alias("blocks")), F.col("unit") == F.col("u"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # Every pair of blocks, and every block with itself, is verified once.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    placed = written.save(placed.withColumn("own", own).withColumn("places", pairs).select("unit", "own", "id", "places"))
    texts = likely(docs, placed.select("id")).join(placed, F.col("doc") == F.col("id")).select("unit", "own", "id", "text", F.explode("places").alias("place"))
    texts = texts.select("unit", "place.i", "place.j", "own", "id", "text").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, owns, sets = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            found = verified(sets, percent, owns if key[1] != key[2] else None)
            if found:
                a, b = zip(*((ids[x], ids[y]) for x, y in found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                keys = zip(*(batch.column(c)[rows].to_pylist() for c in ("unit", "i", "j", "own", "id")), strict=True)
                for (unit, i, j, block, doc), s in zip(keys, shingle_sets(texts, shingle), strict=True):
                    if (unit, i, j) != key:
                        if ids:
                            yield from out()
                        key, ids, owns, sets = (unit, i, j), [], [], []
                    ids.append(doc)
                    owns.append(block)
                    sets.append(s)
        if ids:
            yield from out()

    return written.save(texts.mapInArrow(tidied(run), "a bigint, b bigint"))


def similar_classes(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc, n_shingles, component) of every row; ``component`` is the smallest id reachable by links.

    Two documents link when the Jaccard similarity of their shingle sets is ``percent``
    hundredths or more.  Null and empty texts have no shingles and no links.  Rows that
    repeat an id are one node: their links are united.  A row without an id has itself no
    component (null) and links nothing.  Texts of any length are read whole.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    written = tables(docs.sparkSession)
    source = narrow(docs, id_column, text_column).toDF("doc", "text")
    prefixes = tables(docs.sparkSession)
    marked = prefixes.save(sketches(source, shingle_order(source, shingle), shingle, percent))
    rows = written.save(marked.drop("prefix"))
    filled = rows.where("n > 0 AND doc IS NOT NULL")
    groups = filled.groupBy("g1", "g2").agg(
        F.min("doc").alias("gid"),
        ((F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))).alias("several"),
    )
    groups = written.save(groups)
    heads = marked.where("n > 0 AND doc IS NOT NULL").groupBy("g1", "g2").agg(F.min("doc").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    pairs = group_pairs(heads, percent)
    prefixes.clear()
    # A group with different members is a unit of its own at least.
    edges = pairs.union(groups.where("several").select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    units = components(edges)
    of_group = groups.join(units, F.col("gid") == F.col("id")).select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("root").alias("unit"))
    copies = filled.groupBy("s1", "s2").agg(F.min("doc").alias("id"), F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"))
    copies = written.save(copies)
    members = copies.join(of_group, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2"))).select("id", "n", "unit")
    links = verify_units(source.where("doc IS NOT NULL"), members, shingle, percent)
    roots = components(links).select(F.col("id").alias("node"), "root")
    named = copies.join(roots, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("root", "id").alias("component"))
    out = rows.join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select("doc", F.col("n").alias("n_shingles"), component.alias("component"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Size of each document's set and the class that its links lead to."""
    classes = similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classes.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[u.i : u.i + 2], ' ') AS shingle
    FROM d, unnest(range(1, greatest(len(words) - 1, 2))) AS u(i) WHERE len(words) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reached.id, sides.b FROM reached JOIN sides ON reached.other = sides.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reached GROUP BY id) r USING (doc_id)
"""
