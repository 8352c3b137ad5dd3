"""Line de-duplication over levelled sorted runs of line hashes.

Documents arrive in batches.  A batch's distinct (line, document) pairs are combined to
one row per line hash, and merge-joined with the runs written so far: a line found in none
of them is *fresh*, the anti-join's result, and only its hash, count and largest document
are added; one found there is marked *seen*.  Each batch adds a run, sorted by hash, on
level 0; when a level holds ``fanout`` runs they are compacted into one run of the next.
Only lines that were seen again, or are frequent within one batch, can reach the limit, so
the final merge reads the counts of these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from signaldeck.llm.common import narrow, tables, tidied

MIN_DOCS = 3
MIN_CHARS = 20
BATCHES = 4
FANOUT = 3

_SPACES = " \t\n\x0b\x0c\r"


def split_lines(column: pa.Array) -> pa.ListArray:
    """Lines of each text; a null or empty text is one empty line."""
    return pc.split_pattern(pc.fill_null(column.cast(pa.large_string()), ""), "\n")


def line_keys(lines: pa.Array, min_chars: int) -> list[bytes | None]:
    """128-bit hash of each line's key; None where the key is too short."""
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=_SPACES))
    long_enough = pc.greater_equal(pc.utf8_length(keys), min_chars)
    keys = pc.if_else(long_enough, keys, None).cast(pa.large_binary())
    digest = xxhash.xxh3_128_digest
    return [None if k is None else digest(k) for k in keys.to_pylist()]


def _per_text(lists: pa.ListArray) -> list[int]:
    return pc.list_value_length(lists).to_pylist()


def line_hashes(docs: DataFrame, id_column: str, text_column: str, min_chars: int) -> DataFrame:
    """(line, doc) once for each distinct long line of a row."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                lists = split_lines(part.column(1))
                keys, at = line_keys(lists.flatten(), min_chars), 0
                lines, rows = [], []
                for row, size in enumerate(_per_text(lists)):
                    own = {k for k in keys[at : at + size] if k is not None}
                    lines += own
                    rows += [row] * len(own)
                    at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines, pa.binary()), part.column(0).take(pa.array(rows, pa.int64()))], names=["line", "doc"]
                )

    schema = StructType([StructField("line", BinaryType()), StructField("doc", kind)])
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), schema)


class LineRuns:
    """Levelled runs of (line, docs, top, seen), each a written table sorted by line."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self._tables, self._fanout = tables(spark), fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Add the (line, doc) pairs of a batch."""
        own = batch.groupBy("line").agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
        older = self._all()
        if older is None:
            marked = own.withColumn("seen", F.lit(False))
        else:
            # Lines of a batch are unique, those of several runs may repeat: a semi or anti join adds no rows.
            known = older.select("line")
            fresh = own.join(known, "line", "left_anti").withColumn("seen", F.lit(False))
            again = own.join(known, "line", "left_semi").withColumn("seen", F.lit(True))
            marked = fresh.unionByName(again)
        self._put(0, marked)

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._tables.save(run.sortWithinPartitions("line")))
        if len(self.levels[level]) >= self._fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge the runs of a level into one of the next."""
        runs, self.levels[level] = self.levels[level], []
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        self._put(level + 1, _combined(merged))

    def repeated(self, min_docs: int) -> DataFrame | None:
        """(line, top) of the lines in at least ``min_docs`` documents."""
        rows = self._all()
        if rows is None:
            return None
        may = rows.where(F.col("seen") | (F.col("docs") >= min_docs)).select("line").distinct()
        return _combined(rows.join(may, "line", "left_semi")).where(F.col("docs") >= min_docs).select("line", "top")


def _combined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("line").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"), F.bool_or("seen").alias("seen"))


def dedup_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row as struct ``doc``, ``kept_text``, n_lines and n_dropped.

    Lines whose key (trimmed, A-Z lower-cased) has at least ``min_chars`` code points and
    is in at least ``min_docs`` rows stay only in the row with the largest id among them.
    A null or empty text is one empty line.  Rows that repeat an id count as documents of
    their own and keep or lose a line together.  A row without an id loses the lines that
    any row with an id holds as well, in ``min_docs`` rows or more, and keeps the others.
    A line that repeats within a row counts once and is dropped or kept at all places.  An
    empty table gives no rows.  The columns of a row, or those in ``carry``, stay in ``doc``.
    """
    spark = docs.sparkSession
    written = tables(spark)
    pairs = line_hashes(docs, id_column, text_column, min_chars)
    pairs = pairs.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)))
    pairs = written.save(pairs.select("line", "doc", "batch"))
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(pairs.where(F.col("batch") == number).select("line", "doc"))
    repeated = runs.repeated(min_docs)
    # Each document's lines to drop; one that is frequent is joined by hash, which Spark splits where it is hot.
    dropped = pairs.join(repeated, "line").where(~F.col("doc").eqNullSafe(F.col("top")))
    dropped = dropped.where(F.col("top").isNotNull()).groupBy(F.col("doc").alias("drop_doc")).agg(F.collect_set("line").alias("drop"))
    df = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("doc"),
        F.col(f"`{id_column}`").alias("key"),
        F.col(f"`{text_column}`").alias("text"),
    )
    df = df.join(dropped, df["key"].eqNullSafe(dropped["drop_doc"]), "left").select("doc", "text", "drop")
    kinds = {"doc": df.schema["doc"].dataType, "kept_text": StringType(), "n_lines": LongType(), "n_dropped": LongType()}
    schema = StructType([StructField(name, kind) for name, kind in kinds.items()])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                drops = part.column("drop").to_pylist()
                lists = split_lines(part.column("text"))
                sizes = _per_text(lists)
                kept, gone = pc.fill_null(part.column("text"), "").to_pylist(), [0] * len(sizes)
                for row, drop in enumerate(drops):
                    if drop:
                        lines = lists[row].values
                        drop = set(drop)
                        stays = [t for t, k in zip(lines.to_pylist(), line_keys(lines, min_chars), strict=True) if k not in drop]
                        kept[row], gone[row] = "\n".join(stays), sizes[row] - len(stays)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
                    names=list(kinds),
                )

    return df.mapInArrow(tidied(run), schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of the kept text of every document."""
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=("doc_id",))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: CTEs ``ld_kept`` (doc_id, kept_text, n_lines, n_dropped) over a relation ``lines_in`` (doc_id, text).
KEPT_SQL = r"""
ld_lines AS (
    SELECT doc_id, i, list_extract(string_split(coalesce(text, ''), chr(10)), i) AS line,
        translate(trim(list_extract(string_split(coalesce(text, ''), chr(10)), i), E' \t\n\x0b\x0c\r'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines_in, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
),
ld_frequent AS (
    SELECT key, max(doc_id) AS top FROM ld_lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
ld_kept AS (
    SELECT l.doc_id, count(*)::BIGINT AS n_lines,
        count(*) FILTER (f.top <> l.doc_id)::BIGINT AS n_dropped,
        coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (f.top IS NULL OR f.top = l.doc_id), '') AS kept_text
    FROM ld_lines l LEFT JOIN ld_frequent f USING (key) GROUP BY l.doc_id
)
"""

ORACLE_SQL = (
    "WITH lines_in AS (SELECT doc_id, text FROM documents), "
    + KEPT_SQL
    + "SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM ld_kept"
)
