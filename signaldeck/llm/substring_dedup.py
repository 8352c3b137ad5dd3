"""Removal of repeated passages with sharded Aho-Corasick automata.

1. *Recurring phrases.*  Every window of ``window`` words is marked by the phrase of
   ``PHRASE`` words in it with the smallest hash, so that equal windows are marked by equal
   phrases.  About one word in eight begins such a phrase; only these are shuffled, by
   hash, and those that occur once are let go.
2. *Passages.*  The words around the recurring phrases of a document are cut out as
   regions.  A phrase sends its regions to the shard of the place where it occurs first,
   a stretch of one document, so that the copies of a text meet in few shards.
3. *Automata.*  A shard confirms which windows recur, joins those that occur for the first
   time to passages, and compiles an automaton of short phrases of the passages, one every
   few words, so that each window holds a whole phrase.  Its regions are streamed through
   the automaton, which gives every occurrence: the words around a phrase found are compared
   with those around it in its passage.

Equal windows share a phrase and with it a shard; what one shard finds always has an
earlier copy, so the shards' results are simply united.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from signaldeck.llm.common import FORGET, chunks, narrow, raw_texts, tidied

WINDOW = 20
PHRASE = 6
PIECE = 8
#: Words of a document whose first phrases go to one shard together.
STRETCH = 256
SHARDS_PER_PARTITION = 4
#: Words a shard holds before it settles them and keeps only what is new.
HELD_WORDS = 1_000_000
_CACHE = 400_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()
FORGET.append(WORD_HASHES.clear)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, in order."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = out * _FACTOR + words[j : j + len(out)]
    return mix(out)


def phrase_starts(words: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the row of all texts' words where a marking phrase begins, and its hash."""
    grams = sequence_hashes(words, PHRASE)
    span = window - PHRASE + 1
    windows = len(words) - window + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[: windows] == text[window - 1 :]
    best, at = grams[:windows].copy(), np.zeros(windows, np.int8)
    for j in range(1, span):
        less = grams[j : j + windows] < best
        np.copyto(best, grams[j : j + windows], where=less)
        at[less] = j
    starts = (np.arange(windows) + at)[inside]
    starts = starts[np.concatenate([[True], starts[1:] != starts[:-1]])] if len(starts) else starts
    return starts, grams[starts]


def phrases(docs: DataFrame, window: int) -> DataFrame:
    """(phrase, doc, pos) of the marking phrases of all documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                split = [t.split() for t in texts]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                words = np.fromiter(map(WORD_HASHES.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
                starts, hashes = phrase_starts(words, sizes, window)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                row = np.searchsorted(edges, starts, side="right") - 1
                columns = [pa.array(hashes.view(np.int64)), batch.column("doc")[rows].take(pa.array(row)), pa.array((starts - edges[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["phrase", "doc", "pos"])

    schema = StructType([StructField("phrase", LongType()), docs.schema["doc"]])
    return docs.mapInArrow(tidied(run), schema.add("pos", IntegerType()))


def joined_ranges(places: list[int], before: int, behind: int, end: int) -> list[tuple[int, int]]:
    """Union of [place - before, place + behind) within [0, end)."""
    out: list[list[int]] = []
    for p in sorted(places):
        a, b = max(0, p - before), min(end, p + behind)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def regions(docs: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """(shard, doc, start, words) around the recurring phrases of each document."""
    places = recurring.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("shard", "pos")).alias("places"))
    joined = docs.join(places, F.col("doc") == F.col("of")).select("doc", "text", "places")
    reach = window - PHRASE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                shards, row_of, starts, words_out = [], [], [], []
                for row, (text, places) in enumerate(zip(texts, batch.column("places")[rows].to_pylist(), strict=True)):
                    words, by_shard = text.split(), {}
                    for p in places:
                        by_shard.setdefault(p["shard"], []).append(p["pos"])
                    for shard, at in by_shard.items():
                        for a, b in joined_ranges(at, reach, window, len(words)):
                            shards.append(shard)
                            row_of.append(row)
                            starts.append(a)
                            words_out.append(b" ".join(words[a:b]))
                docs_out = batch.column("doc")[rows].take(pa.array(row_of, pa.int64()))
                columns = [pa.array(shards, pa.int64()), docs_out, pa.array(starts, pa.int64()), pa.array(words_out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc", "start", "words"])

    schema = StructType([StructField("shard", LongType()), docs.schema["doc"], StructField("start", LongType())])
    return joined.mapInArrow(tidied(run), schema.add("words", BinaryType()))


class Shard:
    """Regions of one shard in (document, start) order: finds the repeats among them."""

    def __init__(self, window: int, held_words: int = HELD_WORDS) -> None:
        self._window, self._most, self._limit = window, held_words, held_words
        self._held: list[tuple] = []  # (doc, start, words, was settled before)
        self._size = 0

    def add(self, doc, start: int, words: list[bytes]) -> list[tuple]:
        """Takes a region; returns the spans of regions settled meanwhile."""
        self._held.append((doc, start, words, False))
        self._size += len(words)
        return self.settle() if self._size > self._limit else []

    def settle(self) -> list[tuple]:
        """(doc, begin, end) of all repeats in the regions added since the last time."""
        window, held = self._window, self._held
        if not held:
            return []
        numbers: dict[bytes, int] = {}
        rows = [[numbers.setdefault(w, len(numbers)) for w in words] for _, _, words, _ in held]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter(chain.from_iterable(rows), np.uint64, int(edges[-1]))
        region = np.repeat(np.arange(len(rows)), sizes)
        hashes = sequence_hashes(mix(flat + np.uint64(1)), window)
        inside = np.flatnonzero(region[: len(hashes)] == region[window - 1 :]) if len(hashes) else np.zeros(0, np.int64)
        # Regions are in order, so the first of equal windows is the earliest.
        _, first, counts = np.unique(hashes[inside], return_index=True, return_counts=True)
        new = np.sort(inside[first])
        starts, homes = self._locate(flat, self._joined(inside[first[counts > 1]], region), region)
        earlier = homes < starts
        starts, homes = starts[earlier], homes[earlier]
        # Rows that repeat an id give the same place twice; that is no repeat.
        doc_of, start_of = np.unique([str(h[0]) for h in held], return_inverse=True)[1], np.array([h[1] for h in held], np.int64)
        place = lambda at: start_of[region[at]] + at - edges[region[at]]
        other = (doc_of[region[starts]] != doc_of[region[homes]]) | (place(starts) != place(homes))
        out = []
        for a, b in self._joined(np.unique(starts[other]), region):
            doc, start, _, settled = held[int(region[a])]
            if not settled:
                shift = start - int(edges[region[a]])
                out.append((doc, a + shift, b + shift))
        # Only windows seen for the first time are needed for what follows.
        kept = []
        for a, b in self._joined(new, region):
            r = int(region[a])
            begin = int(a - edges[r])
            kept.append((held[r][0], held[r][1] + begin, held[r][2][begin : begin + int(b - a)], True))
        self._held, self._size = kept, sum(len(k[2]) for k in kept)
        self._limit = max(self._most, 2 * self._size)
        return out

    def _joined(self, starts: np.ndarray, region: np.ndarray) -> list[tuple[int, int]]:
        """Runs of consecutive windows of one region, as ranges of words."""
        starts = np.sort(starts)
        if not len(starts):
            return []
        breaks = np.flatnonzero((np.diff(starts) > 1) | (region[starts[1:]] != region[starts[:-1]])) + 1
        return [(int(run[0]), int(run[-1]) + self._window) for run in np.split(starts, breaks)]

    def _locate(self, flat: np.ndarray, passages: list[tuple[int, int]], region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, start in a passage) of every window that equals one of a passage, word for word.

        The patterns are phrases of the passages, one every few words, so that each window
        holds one whole; it is found with the words around it compared.  Around a phrase that
        passages share, their windows are patterns themselves, so that a place in the text is
        compared with one place of the passages only.
        """
        window, reach = self._window, self._window - PIECE
        none = np.zeros(0, np.int64)
        if not passages:
            return none, none
        letters = "".join(map(chr, (0x10000 + (flat % np.uint64(0xF0000))).tolist()))
        phrases: dict[str, list[tuple[int, int, int]]] = {}
        for a, b in passages:
            for t in range(a, b - PIECE + 1, reach + 1):
                phrases.setdefault(letters[t : t + PIECE], []).append((t, a, b))
        patterns: dict[str, list[int]] = {}
        for phrase, places in phrases.items():
            if len(places) == 1:
                patterns[phrase] = [places[0][0]]
                continue
            for t, a, b in places:
                for p in range(max(a, t - reach), min(t, b - window) + 1):
                    patterns.setdefault(letters[p : p + window], []).append(p)
        automaton = ahocorasick.Automaton()
        for number, pattern in enumerate(patterns):
            automaton.add_word(pattern, number)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(letters)), np.int64).reshape(-1, 2)
        length = np.fromiter(map(len, patterns), np.int64, len(patterns))
        held = np.fromiter(map(len, patterns.values()), np.int64, len(patterns))
        first = np.cumsum(held) - held
        home_of = np.fromiter(chain.from_iterable(patterns.values()), np.int64, int(held.sum()))
        # One row for each place that a pattern found stands for: nearly always one.
        n = held[hits[:, 1]]
        row = np.repeat(np.arange(len(hits)), n)
        number = hits[row, 1]
        home = home_of[first[number] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        size = length[number]
        at = hits[row, 0] - size + 1
        inside = region[at] == region[at + size - 1]
        at, home, size = at[inside], home[inside], size[inside]
        equal = np.ones(len(at), bool)
        for j in range(window):
            k = np.minimum(j, size - 1)
            equal &= flat[at + k] == flat[home + k]
        whole = equal & (size == window)
        starts, homes = [at[whole]], [home[whole]]
        at, home = at[equal & (size != window)], home[equal & (size != window)]
        before, behind = (self._agreeing(flat, region, at + far, home + far, way) for far, way in ((0, -1), (PIECE - 1, 1)))
        for offset in range(reach + 1):
            fits = (before >= offset) & (behind >= reach - offset)
            starts.append(at[fits] - offset)
            homes.append(home[fits] - offset)
        return np.concatenate(starts), np.concatenate(homes)

    def _agreeing(self, flat: np.ndarray, region: np.ndarray, at: np.ndarray, home: np.ndarray, way: int) -> np.ndarray:
        """How many words next to both places agree, up to what a window needs, within the regions."""
        agreed, still = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(1, self._window - PIECE + 1):
            x, y = at + way * j, home + way * j
            valid = (x >= 0) & (y >= 0) & (x < len(flat)) & (y < len(flat))
            x, y = np.where(valid, x, at), np.where(valid, y, home)
            still &= valid & (region[x] == region[at]) & (region[y] == region[home]) & (flat[x] == flat[y])
            agreed += still
        return agreed


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, begin, end): words of documents (doc, text) inside windows that also start earlier."""
    spark = docs.sparkSession
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("phrase")
    marked = phrases(docs, window).withColumn("n", F.count("*").over(same)).withColumn("home", F.min(F.struct("doc", "pos")).over(same))
    stretch = F.xxhash64("home.doc", F.floor(F.col("home.pos") / STRETCH))
    recurring = marked.where("n > 1").select("doc", "pos", F.pmod(stretch, F.lit(shards)).alias("shard"))
    ordered = regions(docs, recurring, window).repartition("shard").sortWithinPartitions("shard", "doc", "start")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, kind = None, Shard(window), None

        def rows(spans: list[tuple]) -> pa.RecordBatch:
            docs_, begins, ends = zip(*spans, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(docs_, kind), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["doc", "begin", "end"])

        for batch in batches:
            kind = batch.schema.field("doc").type
            for key, doc, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = []
                if key != number:
                    spans = shard.settle()
                    number, shard = key, Shard(window)
                spans += shard.add(doc, start, words.split())
                if spans:
                    yield rows(spans)
        if spans := shard.settle():
            yield rows(spans)

    schema = StructType([docs.schema["doc"], StructField("begin", LongType()), StructField("end", LongType())])
    return ordered.mapInArrow(tidied(locate), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``kept_text`` (words that stay, joined by one space), n_words, n_removed and the removed ``spans``.

    A word goes if a window of ``window`` words around it also starts earlier: in a row
    with a smaller id, or further ahead in the same row.  Null and empty texts have no
    words, and texts shorter than a window lose none.  Rows that repeat an id are one
    document: a window at the same place in each of them is no repeat, and what is removed
    at a place is removed in all.  Rows without an id are compared with nothing and stay
    whole.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    if window < PIECE + 1:
        raise ValueError(f"a window has {PIECE + 1} words at least")
    source = narrow(docs, id_column, text_column).toDF("doc", "text")
    found = repeats(source.where("doc IS NOT NULL AND text IS NOT NULL"), window)
    found = found.groupBy(F.col("doc").alias("of")).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    joined = source.join(found, F.col("doc") == F.col("of"), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, united = [], [], [], []
            for text, spans in zip(raw_texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                stays, at, removed, own = [], 0, 0, []
                for s in spans or ():
                    begin, end = max(at, s["begin"]), min(s["end"], len(words))
                    if begin < end:
                        stays += words[at:begin]
                        removed, at = removed + end - begin, end
                        own.append({"begin": begin, "end": end})
                stays += words[at:]
                kept.append(b" ".join(stays).decode())
                sizes.append(len(words))
                gone.append(removed)
                united.append(own)
            ranges = pa.array(united, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            columns = [batch.column("doc"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), ranges]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept_text", "n_words", "n_removed", "spans"])

    span = ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))
    kinds = {"doc_id": source.schema["doc"].dataType, "kept_text": StringType(), "n_words": LongType(), "n_removed": LongType(), "spans": span}
    return joined.mapInArrow(tidied(run), StructType([StructField(c, k) for c, k in kinds.items()]))


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the kept ones of every document."""
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
),
windows AS (
    SELECT doc_id, u.i AS i, array_to_string(words[u.i : u.i + 19], ' ') AS run FROM d, unnest(range(1, len(words) - 18)) AS u(i)
),
again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
),
gone AS (SELECT DISTINCT doc_id, i + o.k AS i FROM again, unnest(range(0, 20)) AS o(k)),
kept AS (
    SELECT w.doc_id, count(g.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '') AS text
    FROM (SELECT doc_id, u.i AS i, words[u.i] AS word FROM d, unnest(range(1, len(words) + 1)) AS u(i)) w
    LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
