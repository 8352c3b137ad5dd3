"""Quality classifier on random-indexing word vectors.

Words are hashed to ``BUCKETS`` rows; each row has a sparse random index vector, and its
word vector is the sum of the index vectors of the words near it in the training texts.
A second, small vocabulary does the same for the shapes of words (case, digits, marks).  A
document is the mean of its word vectors, of its index vectors and of its shapes, with
the lengths of these means, which tell varied texts from repeating ones.  A two-layer
network in numpy scores it, and its temperature is fitted on training rows kept aside.

At most ``TRAIN_ROWS`` labelled rows, the first by a hash of their id, are used to learn
vectors and network; every document is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from signaldeck.llm.common import FORGET, chunks, narrow, tidied

BUCKETS = 1 << 14
SHAPES = 1 << 10
WIDTH = 48
SHAPE_WIDTH = 24
NONZERO = 4
NEAR = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
FOLDS = 5
THRESHOLD = 0.3
CACHE_SIZE = 400_000

_RUNS = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{chr(c): "X" for c in range(65, 91)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}})


def shape_of(word: str) -> str:
    """Runs of upper-case letters, lower-case letters and digits as one sign each; marks stay."""
    plain = word.translate(_SHAPE)
    if not plain.isascii():
        plain = "".join(c if c.isascii() else "X" if c.isupper() else "x" if c.isalpha() else "?" for c in plain)
    return _RUNS.sub(r"\1", plain)


class Codes(dict):
    """word -> bucket * SHAPES + shape bucket, with a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        text = word.decode()
        stem = text.lower().strip(".,;:!?|*#$%&\"'()")
        bucket = xxhash.xxh64_intdigest(stem) % BUCKETS
        self[word] = code = bucket * SHAPES + xxhash.xxh64_intdigest(shape_of(text)) % SHAPES
        return code


_CODES = Codes()
FORGET.append(_CODES.clear)


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape buckets of all texts in a row, and the words of each."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    both = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    return both // SHAPES, both % SHAPES, sizes


def index_vectors(rows: int, width: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, width), np.float32)
    for sign in (1.0, -1.0):
        for _ in range(NONZERO // 2):
            out[np.arange(rows), rng.integers(0, width, rows)] += sign
    return out


INDEX = index_vectors(BUCKETS, WIDTH, 1)
SHAPE_INDEX = index_vectors(SHAPES, SHAPE_WIDTH, 2)


def context_sums(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each bucket, the index vectors of the words up to NEAR places away in the same text, summed."""
    near = np.zeros((len(words), WIDTH), np.float32)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for gap in range(1, NEAR + 1):
        same = (text[gap:] == text[:-gap])[:, None]
        near[gap:] += INDEX[words[:-gap]] * same
        near[:-gap] += INDEX[words[gap:]] * same
    rank = np.argsort(words, kind="stable")
    out = np.zeros((BUCKETS, WIDTH), np.float64)
    if len(words):
        ordered = words[rank]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[starts]] = np.add.reduceat(near[rank], starts, axis=0, dtype=np.float64)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Sums scaled to vectors of length one; words never seen in training are zero."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, size, out=np.zeros_like(sums), where=size > 0).astype(np.float32)


FEATURES = 2 * WIDTH + SHAPE_WIDTH + 4


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row of features per text; empty texts are zero."""
    words, shapes, sizes = codes_of(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    edge = 0
    for row, size in enumerate(sizes.tolist()):
        if size:
            w, s = words[edge : edge + size], shapes[edge : edge + size]
            a, b, c = vectors[w].mean(axis=0), INDEX[w].mean(axis=0), SHAPE_INDEX[s].mean(axis=0)
            norms = [np.log1p(np.linalg.norm(x)) for x in (a, b, c)]
            out[row] = np.concatenate([a, b, c, norms, [np.log1p(size)]])
            edge += size
    return out


class Network:
    """Two-layer network with a temperature: features -> HIDDEN (tanh) -> probability of label 1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, seed: int = 3, epochs: int = 40, step: float = 0.01) -> None:
        rng = np.random.default_rng(seed)
        self.base = (labels.sum() + 1.0) / (len(labels) + 2.0)
        self.fitted = len(np.unique(labels)) == 2
        if not self.fitted:
            return
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
        aside = rng.random(len(rows)) < 0.2
        if len(np.unique(labels[~aside])) < 2 or not aside.any():
            aside = np.zeros(len(rows), bool)
        x, y = self._scaled(rows), labels.astype(np.float64)
        held = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
        fit = np.flatnonzero(~aside)
        self.temperature = 1.0
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for begin in range(0, len(fit), 256):
                part = fit[begin : begin + 256]
                h = np.tanh(x[part] @ w[0] + w[1])
                e = (_sigmoid(h @ w[2] + w[3]) - y[part]) / len(part)
                back = np.outer(e, w[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ e + 1e-4 * w[2], e.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        logits = self._logits(rows[held])
        options = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
        losses = [np.mean(np.logaddexp(0, -(2 * y[held] - 1) * logits / o)) for o in options]
        self.temperature = float(options[int(np.argmin(losses))])

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows.astype(np.float64) - self.mean) / self.scale, -8, 8)

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(self._scaled(rows) @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(rows), self.base)
        return _sigmoid(self._logits(rows) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % folds == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most ``train_rows`` labelled rows outside the held-out fold."""
    known = narrow(labels, id_column, label_column).toDF("id", "label").where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    # At most train_rows ids, whatever the size of the tables.
    sample = narrow(docs, id_column, text_column).toDF("doc", "text").join(F.broadcast(known), F.col("doc") == F.col("id"))
    sample = sample.select("text", "label")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH), np.float64)
        some = False
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                words, _, sizes = codes_of(texts)
                total += context_sums(words, sizes)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    # A few tasks, each of which hands one matrix to the driver.  Only the sampled texts are
    # moved to them: the scan and the join below keep their own width.
    sums = np.zeros((BUCKETS, WIDTH), np.float64)
    for row in sample.select("text").repartition(6).mapInArrow(tidied(contexts), "sums binary").toLocalIterator():
        sums += np.frombuffer(row["sums"], np.float32).reshape(BUCKETS, WIDTH)
    vectors = word_vectors(sums)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                got = [r.tobytes() for r in pooled(texts, shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), batch.column("label")[rows]], names=["features", "label"])

    rows = sorted((bytes(r["features"]), r["label"]) for r in sample.mapInArrow(tidied(features), "features binary, label double").collect())
    table = np.array([np.frombuffer(f, np.float32) for f, _ in rows]).reshape(-1, FEATURES)
    return vectors, Network(table, np.array([y for _, y in rows]))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and score (0 to 1) of every row.

    Null and empty texts have no words and get the score of an all-zero document.  Rows
    that repeat an id, or have none, are scored one by one.  Texts of any length are read
    whole.  Labels that are null or no 0 or 1, and labels of unknown documents, are not
    learned from; of several labels of one id the largest counts.  Without labels of both
    kinds every score is the share of label 1 (a half without any).  An empty table gives
    no rows.  Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for rows, texts in chunks(batch, text_column):
                scores = network.score(pooled(texts, vectors))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(scores, pa.float64())], names=[id_column, "score"])

    kind = docs.schema[id_column].dataType
    schema = StructType([StructField(id_column, kind), StructField("score", DoubleType())])
    return narrow(docs, id_column, text_column).mapInArrow(tidied(run), schema)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labelled ones outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
