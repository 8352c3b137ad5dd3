"""Token counts by a map-side two-tier lookup.

The first tier is a broadcast table of the lengths, in tokens, of the most frequent
pre-tokens of the corpus, at most ``table_size`` of them, packed into two buffers.  The
second is a bounded cache in each worker, filled through the tokenizers library.  Texts
are never shuffled, nor are their pre-tokens: a task counts them in a bounded counter and
hands on the ``task_top`` most frequent ones only.  Counts are exact whatever the table
holds; it only saves calls.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import FORGET, chunks, narrow, tidied
from signaldeck.llm.word_ids import WordEncoder

TABLE_SIZE = 32_768
TASK_TOP = 8_192
#: Distinct words a task counts at once; beyond, the rarest are let go.
COUNTER_SIZE = 200_000
CACHE_SIZE = 400_000
#: Longer words are left to the worker caches, which bounds the broadcast.
LONGEST_WORD = 64


class TokenLengths(dict):
    """Token count by word: the frequent ones for good, others while there is room."""

    def __init__(self, path: str, words: bytes, lengths: bytes, cache_size: int = CACHE_SIZE) -> None:
        self._frequent = dict(zip(words.split(), np.frombuffer(lengths, "<u2").tolist(), strict=True))
        super().__init__(self._frequent)
        self._encode, self._most = WordEncoder(path), len(self._frequent) + cache_size

    def forget(self) -> None:
        """Keep the table alone."""
        self.clear()
        self.update(self._frequent)
        self._encode.forget()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.forget()
        self[word] = size = len(self._encode(word)) // 4
        return size


_OPEN: dict[tuple, TokenLengths] = {}


def _forget() -> None:
    for held in _OPEN.values():
        held.forget()


FORGET.append(_forget)


def frequent_words(docs: DataFrame, text_column: str = "text", table_size: int = TABLE_SIZE) -> list[bytes]:
    """The most frequent white-space words of all texts, at most ``table_size``, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for _, texts in chunks(batch, text_column):
                for text in texts:
                    seen.update(text.split())
                    if len(seen) > 2 * COUNTER_SIZE:
                        seen = Counter(dict(seen.most_common(COUNTER_SIZE)))
        top = [(w, n) for w, n in seen.most_common(TASK_TOP) if len(w) <= LONGEST_WORD]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    counts = narrow(docs, text_column).mapInArrow(tidied(run), "word binary, n bigint")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size)
    return [bytes(row["word"]) for row in top.collect()]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """Id, n_bytes and n_tokens of every row.

    Null and empty texts have no bytes and no tokens.  Rows that repeat an id, or have
    none, are counted one by one.  Words of any length are counted whole.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    encode = WordEncoder(tokenizer)
    # A token count of 2**16 or more cannot occur in a word of at most LONGEST_WORD bytes.
    words = frequent_words(docs, text_column, table_size)
    lengths = np.array([len(encode(w)) // 4 for w in words], "<u2").tobytes()
    table = docs.sparkSession.sparkContext.broadcast((b" ".join(words), lengths))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, table.value)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = TokenLengths(tokenizer, *table.value)
        length_of = _OPEN[key].__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for _, texts in chunks(batch, text_column):
                sizes += map(len, texts)
                tokens += [sum(map(length_of, t.split())) for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_bytes", "n_tokens"])

    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
