"""Sum-of-squares packing of token sequences.

Each task packs the documents of its partition online and without a shuffle.  Whole
multiples of the capacity fill sequences of their own; the rest of a document goes to the
fill level that makes the sum of the squared counts of partially filled sequences
smallest (or opens a sequence, if that is smaller).  The counts by level are one array.
Sequences still open at the end are cut and joined to full ones, and what is left then is
cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import RowSink, chunks, narrow, tidied
from signaldeck.llm.word_ids import word_ids

CAPACITY = 4096
END_ID = 2
#: Open sequences a task holds at most before it cuts and joins them.
MAX_OPEN = 2048


class SumOfSquares:
    """Open sequences of one task, by fill level."""

    def __init__(self, capacity: int, max_open: int = MAX_OPEN) -> None:
        self._capacity, self._max_open = capacity, max_open
        self._count = np.zeros(capacity + 1, np.int64)
        self._at: dict[int, list[list]] = {}
        self._open = 0

    def level_for(self, size: int) -> int:
        """Fill level to use for a piece of ``size``; 0 opens a sequence.  Ties go to the fullest."""
        n, c = self._count, self._capacity
        # Moving one sequence from level h to h + size changes the sum by 2 (n[h + size] - n[h]) + 2.
        change = 2 * (n[size + 1 : c + 1] - n[1 : c - size + 1]) + 2
        change[-1:] -= 1  # a full sequence is no longer counted
        change[n[1 : c - size + 1] == 0] = np.iinfo(np.int64).max
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[size] + 1 else 0

    def place(self, piece: tuple, size: int) -> list[list[tuple]]:
        """Add a piece of less than the capacity; returns the sequences that became full."""
        level = self.level_for(size)
        if level:
            held = self._at[level].pop()
            self._count[level] -= 1
        else:
            held = []
            self._open += 1
        held.append(piece)
        fill = level + size
        if fill == self._capacity:
            self._open -= 1
            return [held]
        self._at.setdefault(fill, []).append(held)
        self._count[fill] += 1
        return self.close(last=False) if self._open > self._max_open else []

    def close(self, last: bool = True) -> list[list[tuple]]:
        """Cut and join the open sequences; pieces are (document, start, ids)."""
        pieces = [p for level in sorted(self._at, reverse=True) for held in self._at[level] for p in held]
        self._at, self._open = {}, 0
        self._count[:] = 0
        full, held, fill = [], [], 0
        for doc, start, ids in pieces:
            while len(ids):
                part = ids[: self._capacity - fill]
                held.append((doc, start, part))
                start, ids, fill = start + len(part), ids[len(part) :], fill + len(part)
                if fill == self._capacity:
                    full.append(held)
                    held, fill = [], 0
        if fill and not last:
            self._at[fill] = [held]
            self._count[fill] = self._open = 1
            return full
        while fill:
            size = 1 << (fill.bit_length() - 1)
            sequence, got = [], 0
            while got < size:
                doc, start, ids = held.pop(0)
                part = ids[: size - got]
                sequence.append((doc, start, part))
                got += len(part)
                if len(part) < len(ids):
                    held.insert(0, (doc, start + len(part), ids[len(part) :]))
            full.append(sequence)
            fill -= size
        return full


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of packed sequences: id, start, length, ids (BINARY, little-endian uint32), doc_tokens,
    sequence_id, offset.

    A null or empty text is a document of the end id alone.  Rows that repeat an id, and
    rows without one, are packed as documents of their own.  Texts of any length are cut
    into as many sequences as they need.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.  ``sequence_id`` is the task's number in the upper bits
    and a running number below, so that a repeated task numbers alike.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, sink = word_ids(tokenizer), SumOfSquares(capacity), None
        number = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4")

        def emit(sequences: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for sequence in sequences:
                offset = 0
                for (doc, total), start, ids in sequence:
                    yield from sink.add((doc, start, len(ids), ids.tobytes(), total, number, offset), 4 * len(ids))
                    offset += len(ids)
                number += 1

        for batch in batches:
            if sink is None:
                names = [(id_column, batch.schema.field(0).type), *((n, pa.int64()) for n in ("start", "length"))]
                names += [("ids", pa.binary()), *((n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset"))]
                sink = RowSink(pa.schema(names))
            keys = batch.column(0)
            for rows, texts in chunks(batch, text_column):
                ids, sizes = encoder.encode(texts)
                edge = 0
                for doc, size in zip(keys[rows].to_pylist(), sizes.tolist(), strict=True):
                    own = np.concatenate([ids[edge : edge + size], end])
                    edge += size
                    about = (doc, size + 1)
                    cut = len(own) - len(own) % capacity
                    for start in range(0, cut, capacity):
                        yield from emit([[(about, start, own[start : start + capacity])]])
                    if cut < len(own):
                        yield from emit(packer.place((about, cut, own[cut:]), len(own) - cut))
        if sink is not None:
            yield from emit(packer.close())
            yield from sink.flush()

    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), out)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return piece_digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
