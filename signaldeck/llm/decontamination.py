"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are compiled into automata of bounded size; each is broadcast
and every document streams its words through it.  The automaton gives, at each word, the
longest run of words ending there that some item contains; a run of the window's length
(or a whole shorter item) is a hit.  Words that no item has break every match, so only
stretches of known words that are long enough are walked at all.  Beyond the words of one
automaton, items go to further ones, through which the documents stream in turn.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from signaldeck.llm.common import narrow, raw_texts, tidied

WINDOW = 10
#: Item words compiled into one automaton at most, unless a single item has more.
SHARD_WORDS = 500_000

#: Lower case for A-Z; every other ASCII byte that is no digit or letter becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of the word sequences of several items, read-only once built."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.shortest = window
        ends: list[tuple[int, int, bool]] = []
        for name, words in items:
            if not words:
                continue
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if i + 1 >= window:
                    ends.append((last, number[name], False))
            if len(words) < window:
                ends.append((last, number[name], True))
                self.shortest = min(self.shortest, len(words))
        # Items with a window that ends in a state: those of the states below it in the link tree.
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, set[int]] = {}
        for state, item, short in ends:
            if short:
                self.whole.setdefault(state, set()).add(item)
                continue
            while self.length[state] >= window:
                held = self.items.setdefault(state, set())
                if item in held:
                    break
                held.add(item)
                state = self.link[state]

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, symbol)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last != -1 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        if last != -1:
            below = self.next[last][symbol]
            same = self.length[below] == self.length[last] + 1
            self.link[state] = below if same else self._split(last, below, symbol)
        return state

    def _split(self, last: int, state: int, symbol: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[state]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[state])
        self.link[state] = copy
        while last != -1 and self.next[last].get(symbol) == state:
            self.next[last][symbol] = copy
            last = self.link[last]
        return copy

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words inside occurrences, merged, and the items with occurring windows."""
        get = self.vocabulary.get
        symbols = [get(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        begin = 0
        for known, run in groupby(symbols, key=(-1).__ne__):
            size = sum(1 for _ in run)
            if known and size >= self.shortest:
                self._walk(symbols, begin, begin + size, spans, found)
            begin += size
        return spans, {self.names[i] for i in found}

    def _walk(self, symbols: list[int], begin: int, end: int, spans: list, found: set[int]) -> None:
        step, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i in range(begin, end):
            symbol = symbols[i]
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                matched += 1
            if matched < self.shortest:
                continue
            hit, at = 0, state
            if matched >= window:
                # The state of the last `window` words alone: all items that have them.
                while length[link[at]] >= window:
                    at = link[at]
                hit = window
                found |= self.items[at]
            if self.whole:
                at = state
                while at:
                    # A whole short item is the longest string of its state.
                    if at in self.whole and length[at] <= matched:
                        hit = max(hit, length[at])
                        found |= self.whole[at]
                    at = link[at]
            if hit:
                first = i + 1 - hit
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))


def item_shards(items: DataFrame, id_column: str, text_column: str, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of bounded size, one group at a time on the driver."""
    group, size = [], 0
    for row in narrow(items, id_column, text_column).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        words = fold_words(row[1].encode())
        if group and size + len(words) > shard_words:
            yield group
            group, size = [], 0
        group.append((str(row[0]), words))
        size += len(words)
    if group:
        yield group


def matches(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    shard_words: int = SHARD_WORDS,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row as struct ``doc``, n_words, ``spans`` of hit words (begin, end) and the ``items`` that occur.

    A null or empty text has no words.  Items without an id or text are ignored; several
    items may share a text, and all are reported.  Item ids that repeat are one item with
    several texts.  Empty tables give no rows, or rows without hits.  The columns of a row, or
    those named in ``carry``, stay inside ``doc``, whatever their names.
    """
    spark = docs.sparkSession
    if not isinstance(window, int) or window < 1:
        raise ValueError("a window has one word at least")
    df = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("doc"),
        F.col(f"`{text_column}`").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    kinds = {"doc": df.schema["doc"].dataType, "text": StringType(), "n_words": LongType()}
    kinds |= {"spans": ArrayType(span), "items": ArrayType(StringType())}
    schema = StructType([StructField(name, kind) for name, kind in kinds.items()])

    def stage(automaton) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = automaton.value if automaton is not None else ItemAutomaton([], window)
            for batch in batches:
                for begin in range(0, batch.num_rows, 1000):
                    part = batch.slice(begin, 1000)
                    sizes, spans, names = [], [], []
                    for text, old, known in zip(
                        raw_texts(part.column("text")), part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True
                    ):
                        words = fold_words(text)
                        got, ids = built.match(words)
                        sizes.append(len(words))
                        spans.append(merged([(s["begin"], s["end"]) for s in old] + got) if old else [{"begin": a, "end": b} for a, b in got])
                        names.append(sorted({*known, *ids}))
                    columns = {"doc": part.column("doc"), "text": part.column("text"), "n_words": pa.array(sizes, pa.int64())}
                    columns["spans"] = pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                    columns["items"] = pa.array(names, pa.list_(pa.string()))
                    yield pa.RecordBatch.from_pydict(columns)

        return df.mapInArrow(tidied(run), schema)

    some = False
    for shard in item_shards(items, item_id_column, item_text_column, shard_words):
        some = True
        df = stage(spark.sparkContext.broadcast(ItemAutomaton(shard, window)))
    return (df if some else stage(None)).drop("text")


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [{"begin": a, "end": b} for a, b in out]


def with_hits(found: DataFrame) -> DataFrame:
    """Adds n_hit, the number of words inside the spans."""
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"])
    return found.withColumn("n_hit", total)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words and benchmark items hit in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_hits(matches(docs, items, carry=("doc_id",))).select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, max_share: float = 0.5, text_column: str = "text", **names) -> DataFrame:
    """The rows with benchmark spans cut out, all columns kept.

    The words of each hit span, and what lies between them, leave the text; the rest of
    it is unchanged.  Documents with more than ``max_share`` of their words in such spans go.
    """
    found = with_hits(matches(docs, items, text_column=text_column, **names))
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {name: batch.column("doc").field(i) for i, name in enumerate(columns)}
            texts, spans = kept[text_column], batch.column("spans").to_pylist()
            cut = [cut_spans(x.as_py().encode(), s) if s else x.as_py() for x, s in zip(texts, spans, strict=True)]
            kept[text_column] = pa.array(cut, texts.type)
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=columns)

    stays = F.col("n_hit") <= F.lit(max_share) * F.col("n_words")
    return found.where(stays).select("doc", "spans").mapInArrow(tidied(run), schema)


_WORD_BYTE = bytes(0 if _FOLD[b] == 0x20 else 1 for b in range(256))


def cut_spans(text: bytes, spans: list[dict]) -> str:
    """The text without the words of the spans and what lies between those of one span."""
    bounds, inside = [], False
    for i, b in enumerate(text.translate(_WORD_BYTE)):
        if bool(b) != inside:
            bounds.append(i)
            inside = not inside
    if inside:
        bounds.append(len(text))
    out, at = [], 0
    for s in spans:
        out.append(text[at : bounds[2 * s["begin"]]])
        at = bounds[2 * s["end"] - 1]
    out.append(text[at:])
    return b"".join(out).decode()



_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
    SELECT DISTINCT item_id::VARCHAR AS item_id, least(len(words), 10) AS size,
        array_to_string(words[u.i : u.i + least(len(words), 10) - 1], ' ') AS run
    FROM items, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS u(i) WHERE len(words) > 0
),
hits AS (
    SELECT DISTINCT d.doc_id, u.i AS i, s.size, w.item_id
    FROM (SELECT DISTINCT size FROM item_windows) s, d, unnest(range(1, len(words) - s.size + 2)) AS u(i), item_windows w
    WHERE w.size = s.size AND w.run = array_to_string(words[u.i : u.i + s.size - 1], ' ')
),
hit_words AS (
    SELECT doc_id, count(DISTINCT i + o.k) AS n FROM hits, unnest(range(0, 10)) AS o(k) WHERE o.k < size GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
    sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
