"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.session import LineageCut

#: Rows per Arrow batch are cut further so that a worker holds about this much text.
CHUNK_BYTES = 4 << 20


def tables(spark: SparkSession) -> LineageCut:
    """Written tables in the cluster's shared folder; each save keeps the earlier ones."""
    return LineageCut(spark, keep_all=True)


def _importable(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver found it, if it isn't installed there."""
    own, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, own])


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra ones of any name are left behind at the scan."""
    _importable(docs.sparkSession)
    return docs.select(*(F.col(f"`{c}`").alias(c) for c in columns))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive row ranges of a batch with about ``limit`` bytes of text each."""
    texts = raw_texts(batch.column(text))
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= limit or i + 1 == len(texts):
            yield slice(begin, i + 1), texts[begin : i + 1]
            begin, size = i + 1, 0


#: Functions that empty the caches of a worker.
FORGET: list[Callable[[], None]] = []


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The batch function, with the worker's caches and spare memory given back behind it.

    Workers outlive their tasks; what one keeps would lie beside the next stage's needs.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for forget in FORGET:
                forget()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return whole


class RowSink:
    """Collects rows and hands them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = 4 << 20) -> None:
        self._schema, self._max_rows, self._max_bytes = schema, max_rows, max_bytes
        self._rows: list[tuple] = []
        self._bytes = 0

    def add(self, row: tuple, size: int = 0) -> Iterable[pa.RecordBatch]:
        self._rows.append(row)
        self._bytes += size
        if len(self._rows) >= self._max_rows or self._bytes >= self._max_bytes:
            return self.flush()
        return ()

    def flush(self) -> list[pa.RecordBatch]:
        if not self._rows:
            return []
        columns = list(zip(*self._rows, strict=True))
        self._rows, self._bytes = [], 0
        return [
            pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, self._schema, strict=True)], schema=self._schema
            )
        ]
