"""Product codes of vectors by member-resident Lloyd rounds.

Every vector is cut into parts.  A part is a row that lives with its owner, which is
(position, entry, salt): one bucket of a bucketed table in the shared folder.  In a round,
owners add up their resident members where they lie (no exchange), the sums of all salts
give the new entries, and members look for their nearest entry again.  Members that keep
theirs are written back to their bucket by the task that read them; only those that change
entry go through the shuffle.  The salt comes from the row's number, so an entry that holds
most of the parts is spread over all buckets.  A lost executor costs a task of one round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import narrow, tables, tidied

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integer components stay below this, so that every distance and sum is exact.
LARGEST = 1 << 26


def quantised(vectors: list[list[float]] | np.ndarray, scale: int) -> np.ndarray:
    """Integers floor(scale * x)."""
    whole = np.floor(scale * np.asarray(vectors, np.float64))
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a vector component lies outside of +-{LARGEST / scale:g}")
    return whole.astype(np.int64)


def nearest(parts: np.ndarray, position: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part; the lower index of equally near ones."""
    entry = np.zeros(len(parts), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for e in range(codebooks.shape[1]):
        away = parts - codebooks[position, e]
        away = np.einsum("ij,ij->i", away, away)
        entry[away < least] = e
        least = np.minimum(least, away)
    return entry, least


def _finite(vector: str):
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


class _Members:
    """The bucketed table of parts; each save replaces the one before."""

    def __init__(self, spark, buckets: int) -> None:
        self._spark, self._work, self._buckets = spark, tables(spark), buckets
        self._held: tuple[str, str] | None = None

    def save(self, df: DataFrame) -> DataFrame:
        name, path = f"members_{uuid.uuid4().hex}", self._work.new_path()
        df.write.bucketBy(self._buckets, "owner").option("path", path).saveAsTable(name)
        self.drop()
        self._held = name, path
        return self._spark.table(name)

    def drop(self) -> None:
        if self._held:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._held[0]}")
            self._work.remove(self._held[1])
            self._held = None


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Id, label, codes (ARRAY<INT>, one entry number by part) and error of every vector kept, and the codebooks.

    Rows whose vector is null or holds a null or a component that is not finite are left
    out.  Codebooks begin with the vectors of the smallest ids (rows without an id last;
    of rows that repeat an id, the smaller vector first); with fewer rows than ``entries``
    they are as short.  Repeated rows and rows without an id are coded one by one.
    Codebooks have the shape (parts, entries, width).  An empty table gives no rows.
    Vectors of different lengths, or whose length is no multiple of ``parts``, and
    components of 2**26 / ``scale`` or more are errors.  Other columns are ignored,
    whatever their names.
    """
    spark = vectors.sparkSession
    rows = narrow(vectors, id_column, vector_column, label_column).toDF("id", "vector", "label").where(_finite("vector"))
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector", F.col("label").asc_nulls_last()).limit(entries).collect()
    length = len(seeds[0]["vector"]) if seeds else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} parts")
    if any(len(r["vector"]) != length for r in seeds):
        raise ValueError(f"vectors are expected to have {length} components")
    width, entries = length // parts, max(len(seeds), 1)
    first = [r["vector"] for r in seeds] or np.zeros((1, 0))
    codebooks = quantised(first, scale).reshape(entries, parts, width).transpose(1, 0, 2).copy()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = ["row", "id", "label", "position", "entry", "owner", "part"]
    schema = f"row bigint, id {kinds['id']}, label {kinds['label']}, position int, entry int, owner int, part array<int>"

    def owner(position: np.ndarray, entry: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (position * entries + entry) * buckets + row % buckets

    def member_batch(row, ids, labels, position, entry, part) -> pa.RecordBatch:
        ints = [pa.array(x, pa.int32()) for x in (position, entry, owner(position, entry, row))]
        cells = pa.array(np.ascontiguousarray(part, np.int32).reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * width, pa.int32()), cells)
        return pa.RecordBatch.from_arrays([pa.array(row), ids, labels, *ints, lists], names=columns)

    def cut(batches: Iterator[pa.RecordBatch], books: np.ndarray = codebooks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                held = some.column("vector")
                if len(flat := held.flatten()) != len(held) * length or set(held.value_lengths().to_pylist()) - {length}:
                    raise ValueError(f"vectors are expected to have {length} components")
                whole = quantised(flat.to_numpy(zero_copy_only=False), scale).reshape(-1, width)
                row = np.repeat(some.column("row").to_numpy(), parts)
                position = np.tile(np.arange(parts), len(held))
                # Id and label travel with the first part only.
                at = pa.array(np.repeat(np.arange(len(held)), parts), mask=position > 0)
                entry, _ = nearest(whole, position, books)
                yield member_batch(row, some.column("id").take(at), some.column("label").take(at), position, entry, whole)

    def parts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.reshape(batch.num_rows, width), *(batch.column(c).to_numpy().astype(np.int64) for c in ("position", "entry", "row"))

    def changed(books: np.ndarray, moving: bool):
        """Members that keep their entry, or those that change it, with the new one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, position, before, row = parts_of(batch)
                entry, _ = nearest(part, position, books)
                take = np.flatnonzero((entry != before) == moving)
                own = [batch.column(c).take(pa.array(take)) for c in ("id", "label")]
                yield member_batch(row[take], *own, position[take], entry[take], part[take])

        return tidied(run)

    def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
        """The owners' sums, then those of all salts; entries without a member stay."""
        cells = [F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(width)]
        owned = members.groupBy("owner", "position", "entry").agg(F.count("*").alias("n"), *cells)
        sums = owned.groupBy("position", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(width))]))
        books = books.copy()
        for r in sums.collect():  # one row per entry
            books[r["position"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        return books

    held = _Members(spark, buckets)
    placed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(tidied(cut), schema)
    members = held.save(placed.repartition(buckets, "owner"))
    for turn in range(rounds):
        if turn:
            moved = members.mapInArrow(changed(codebooks, True), schema).repartition(buckets, "owner")
            members = held.save(members.mapInArrow(changed(codebooks, False), schema).union(moved))
        codebooks = updated(members, codebooks)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, position, _, _ = parts_of(batch)
            entry, away = nearest(part, position, codebooks)
            own = [batch.column(c) for c in ("row", "id", "label", "position")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(entry, pa.int32()), pa.array(away)], names=["row", "id", "label", "position", "entry", "away"])

    final = members.mapInArrow(
        tidied(finish), f"row bigint, id {kinds['id']}, label {kinds['label']}, position int, entry int, away bigint"
    )
    at = [F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)]
    joined = final.groupBy("row").agg(F.max("id").alias("id"), F.max("label").alias("label"), F.sum("away").alias("error"), *at)
    coded = joined.select(
        F.col("id").alias(id_column), F.col("label").alias(label_column), F.array(*(f"e{p}" for p in range(parts))).alias("codes"), "error"
    )
    coded = tables(spark).save(coded)
    held.drop()
    return coded, codebooks


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, the error of its label, and a checksum of the codebooks."""
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = tables(spark).save(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    digits = F.transform("codes", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return joined.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle_sql() -> str:
    steps = [
        f"""vq_kept AS (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
vq_parts AS MATERIALIZED (
    SELECT r, p.p AS p, k.k AS k, v[p.p * (len(v) // {PARTS}) + k.k] AS x
    FROM vq_kept, range({PARTS}) AS p(p), unnest(range(1, len(v) // {PARTS} + 1)) AS k(k)
),
vq_seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM vq_kept QUALIFY e < {ENTRIES}),
vq_book0 AS MATERIALIZED (SELECT p, e, k, x AS c FROM vq_parts JOIN vq_seeds USING (r))"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""vq_near{n} AS MATERIALIZED (
    SELECT r, p, e, d FROM
        (SELECT r, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM vq_parts JOIN vq_book{n} USING (p, k) GROUP BY r, p, e)
    QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1
)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""vq_book{n + 1} AS MATERIALIZED (
    SELECT p, e, k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM vq_book{n} LEFT JOIN
        (SELECT p, e, k, sum(x)::BIGINT AS s, count(*) AS n FROM vq_parts JOIN vq_near{n} USING (r, p) GROUP BY p, e, k)
    USING (p, e, k)
)"""
            )
    return (
        "WITH " + ",\n".join(steps) + f""",
vq_coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM vq_near{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, k)) FROM vq_book{ROUNDS}) AS codebooks_sha256
FROM vq_kept JOIN vq_coded USING (r)"""
    )


ORACLE_SQL = _oracle_sql()
