"""Token ids in Huffman-coded blocks.

Ids are counted over all documents; a canonical code with at most ``longest`` bits a
symbol is made from the counts, which are bounded by the vocabulary.  The file format is a
folder with three Parquet tables:

* ``code``: id and code length of every symbol that occurs; the codes follow from these.
* ``blocks``: one row per run of documents, in ascending id order: part, block, the ids
  of its part before it, the keys, token counts and stream bytes of its documents, the bit
  stream of all of them, and checkpoints, the bit offset (as differences) of every
  ``stride``-th symbol.  A block decodes on its own.
* ``parts``: the number of ids before each part.

A block is decoded with a table from the next ``longest`` bits to symbol and length,
beginning at all its checkpoints at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from signaldeck.llm.common import chunks, narrow, tables, tidied
from signaldeck.llm.word_ids import word_ids

END_ID = 1
LONGEST = 20
STRIDE = 64
BLOCK_IDS = 1 << 18


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Optimal code lengths of at most ``longest`` bits, by package-merge.

    A single symbol gets one bit.  Symbols are taken by (count, id), so that equal tables
    give equal codes.
    """
    order = sorted(counts, key=lambda s: (counts[s], s))
    n = len(order)
    if n <= 1:
        return dict.fromkeys(order, 1)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes longer than {longest} bits")
    weights = np.array([counts[s] for s in order], np.int64)
    # Each level merges the symbols with the pairs of the level below; which entries are
    # symbols is all that the way back needs.
    is_symbol, level = [], weights
    for _ in range(longest):
        is_symbol.append(np.ones(n, bool) if level is weights else flags)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        flags = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        rank = np.argsort(both, kind="stable")
        level, flags = both[rank], flags[rank]
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for flags in reversed(is_symbol):
        symbols = int(flags[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    return dict(zip(order, lengths.tolist(), strict=True))


class CanonicalCode:
    """Code words and the decoding table of canonical code lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        rank = np.lexsort((symbols, lengths))
        self.symbols, lengths = symbols[rank].astype(np.int64), lengths[rank].astype(np.int64)
        self.longest = int(lengths.max(initial=1))
        # In canonical order, each code is the one before plus one, widened to its length.
        room = np.left_shift(1, self.longest - lengths)
        first = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(room) else room
        size = int(self.symbols.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.symbols] = np.right_shift(first, self.longest - lengths).astype(np.uint64)
        self.length[self.symbols] = lengths
        self._symbol_at = np.repeat(self.symbols, room).astype(np.uint32)
        self._length_at = np.repeat(lengths, room).astype(np.uint8)

    def encode(self, ids: np.ndarray, counts: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bit stream of several documents, each begun at a whole byte.

        Returns it with the bytes of each document, the checkpoints of all (bits between
        one and the next, 0 at a document's start) and their number by document.
        """
        lanes = -(-counts // stride)
        if not len(ids):
            return b"", np.zeros(len(counts), np.int64), np.zeros(0, np.int64), lanes
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        in_bytes = (np.diff(edges) + 7) >> 3
        bases = 8 * np.concatenate([[0], np.cumsum(in_bytes)])
        begins = ends - sizes + np.repeat(bases[:-1] - edges[:-1], counts)
        # A code lies in one 32-bit word or two: as the upper bits of 64 starting at its word.
        word = begins >> 5
        wide = self.code[ids] << (64 - (begins & 31) - sizes).astype(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sums = np.bitwise_or.reduceat(wide, starts)
        out, at = np.zeros(int(bases[-1] >> 5) + 2, np.uint32), word[starts]
        out[at] = (sums >> np.uint64(32)).astype(np.uint32)
        out[at + 1] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        stream = out.astype(">u4").tobytes()[: int(bases[-1] >> 3)]
        # Every stride-th id of each document.
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        marks = begins[np.repeat(np.cumsum(counts) - counts, lanes) + stride * place]
        steps = np.diff(marks, prepend=0)
        steps[place == 0] = 0
        return stream, in_bytes, steps, lanes

    def decode(self, stream: bytes, count: int, marks: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """The ids; ``marks`` are the bit offsets of every ``stride``-th one."""
        out = np.zeros((len(marks), stride), np.uint32)
        padded = np.frombuffer(stream + bytes(12 - len(stream) % 4), ">u4").astype(np.uint64)
        pairs = (padded[:-1] << np.uint64(32)) | padded[1:]
        at, mask = marks.astype(np.int64), (1 << self.longest) - 1
        last = len(pairs) - 1
        for step in range(stride):
            shift = (64 - self.longest - (at & 31)).astype(np.uint64)
            seen = (pairs[np.minimum(at >> 5, last)] >> shift).astype(np.int64) & mask
            seen = np.minimum(seen, len(self._symbol_at) - 1)  # behind the end only
            out[:, step] = self._symbol_at[seen]
            at = at + self._length_at[seen]
        return out.reshape(-1)[:count]


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_column: str, text_column: str, width: str) -> DataFrame:
    """doc, n and ids (little-endian, of numpy type ``width``) of each row."""
    of = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(tokenizer), np.array([end_id], width).tobytes()
        for batch in batches:
            for rows, texts in chunks(batch, text_column):
                ids, sizes = encoder.encode(texts)
                flat, edges = ids.astype(width).tobytes(), of * np.concatenate([[0], np.cumsum(sizes)])
                own = [flat[a:b] + end for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(sizes + 1, pa.int64()), pa.array(own, pa.binary())], names=["doc", "n", "ids"]
                )

    kind = docs.schema[id_column].dataType
    schema = StructType([StructField("doc", kind), StructField("n", LongType()), StructField("ids", BinaryType())])
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), schema)


def id_counts(rows: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs; a task hands on one row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
            total[: len(seen)] += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counted = rows.select("ids").mapInArrow(tidied(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {row["id"]: row["n"] for row in counted.collect()}


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = LONGEST,
    stride: int = STRIDE,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write all rows' ids to a new ``folder``.

    A null or empty text has the end id alone.  Rows without an id come first, rows that
    repeat one follow each other (shorter and then by checksum first).  An empty table
    gives a folder without blocks.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    width = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    # Counts and blocks both need the ids: they are written once.
    work = tables(spark)
    ids_path = work.new_path()
    rows = token_table(docs, tokenizer, end_id, id_column, text_column, width)
    rows.write.option("compression", "zstd").parquet(ids_path)
    rows = spark.read.schema(rows.schema).parquet(ids_path)
    lengths = code_lengths(id_counts(rows, width), longest)
    spark.createDataFrame(sorted(lengths.items()), "id bigint, bits bigint").coalesce(1).write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast(_arrays(lengths))
    # Parts are ranges of document ids, by quantiles of the id column alone.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("doc", [i / n_parts for i in range(1, n_parts)] or [0.5], 100 * n_parts)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = CanonicalCode(*code.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                counts = part.column("n").to_numpy()
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), width)
                stream, in_bytes, steps, lanes = built.encode(ids, counts, stride)
                edges, lane_edges = np.concatenate([[0], np.cumsum(in_bytes)]), 2 * np.concatenate([[0], np.cumsum(lanes)])
                steps = steps.astype("<u2").tobytes()
                cut = lambda whole, at: pa.array([whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())  # noqa: B023,B905,E731
                keys = part.column("doc").fill_null(-(1 << 63)).to_numpy()
                number = pa.array(np.searchsorted(bounds, keys), pa.int64())
                columns = [number, part.column("doc"), part.column("n"), cut(stream, edges), cut(steps, lane_edges)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc", "n", "stream", "marks"])

    long, blob = LongType(), BinaryType()
    kinds = {"part": long, "doc": rows.schema["doc"].dataType, "n": long, "stream": blob, "marks": blob}
    coded = rows.mapInArrow(tidied(encode), StructType([StructField(c, k) for c, k in kinds.items()]))
    # Only coded streams are shuffled, each part to one task, and sorted there.
    coded = coded.repartition("part").sortWithinPartitions("part", "doc", "n", F.crc32("stream"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, inside, held, size = None, 0, 0, [], 0

        def row() -> pa.RecordBatch:
            docs_, ns, streams, marks = zip(*held, strict=True)
            values = [part, block, inside, list(docs_), list(ns), [len(s) for s in streams], b"".join(streams), b"".join(marks)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=BLOCK_COLUMNS)

        for batch in batches:
            types = [*[pa.int64()] * 3, pa.list_(batch.schema.field("doc").type), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.binary()]
            for number, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (number != part or size >= block_ids):
                    yield row()
                    block, inside, held, size = block + 1, inside + size, [], 0
                if number != part:
                    part, block, inside = number, 0, 0
                held.append(values)
                size += values[1]
        if held:
            yield row()

    doc_type = kinds["doc"].simpleString()
    block_schema = f"part bigint, block bigint, inside bigint, docs array<{doc_type}>, counts array<bigint>, sizes array<bigint>, stream binary, marks binary"
    coded.mapInArrow(tidied(join), block_schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    work.remove(ids_path)
    parts = spark.read.parquet(f"{folder}/blocks").select("part", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    totals = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, out = 0, []
    for part, n in totals:  # one row per part
        out.append((part, before))
        before += n
    spark.createDataFrame(out, "part bigint, before bigint").coalesce(1).write.parquet(f"{folder}/parts")


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


BLOCK_COLUMNS = ["part", "block", "inside", "docs", "counts", "sizes", "stream", "marks"]


def _arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(lengths), np.int64), np.array(list(lengths.values()), np.int64)


def read_token_files(spark: SparkSession, folder: str, stride: int = STRIDE) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, decoded from the files."""
    code_rows = spark.read.parquet(f"{folder}/code").collect()  # bounded by the vocabulary
    code = spark.sparkContext.broadcast(_arrays({r["id"]: r["bits"] for r in code_rows}))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["docs"].dataType.elementType
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = CanonicalCode(*code.value)
        for batch in batches:
            for i in range(batch.num_rows):
                inside, docs, counts, sizes, stream, marks = (batch.column(c)[i].as_py() for c in BLOCK_COLUMNS[2:])
                ids = decode_block(built, counts, sizes, stream, marks, stride)
                start = batch.column("before")[i].as_py() + inside
                edges = np.concatenate([[0], np.cumsum(counts)])
                flat = ids.astype("<u4").tobytes()
                own = [flat[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, batch.schema.field("docs").type.value_type), pa.array(start + edges[:-1]), pa.array(counts, pa.int64()), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    schema = StructType(
        [StructField("doc_id", kind), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    )
    # One row per part, which Spark broadcasts by its measured size.
    parts = spark.read.parquet(f"{folder}/parts")
    return blocks.join(parts, "part").select(*BLOCK_COLUMNS, "before").mapInArrow(tidied(decode), schema)


def decode_block(code: CanonicalCode, counts: list[int], sizes: list[int], stream: bytes, marks: bytes, stride: int) -> np.ndarray:
    """Ids of all documents of a block; their streams begin at whole bytes."""
    counts_, bases = np.array(counts, np.int64), 8 * np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    lanes = -(-counts_ // stride)  # a document has its end id at least
    steps = np.frombuffer(marks, "<u2").astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
    run = np.cumsum(steps)
    at = run - np.repeat(run[first] - steps[first], lanes) + np.repeat(bases, lanes)
    ids = code.decode(stream, len(at) * stride, at, stride).reshape(-1, stride)
    # The last lane of a document may be filled in part only.
    used = np.full(len(at), stride, np.int64)
    used[first + lanes - 1] = counts_ - (lanes - 1) * stride
    return ids[np.arange(stride) < used[:, None]]


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, written to files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = tables(spark).new_path()
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

