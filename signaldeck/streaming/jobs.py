"""Continuous forms of the batch operators (Structured Streaming)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signaldeck.functions import ids
from signaldeck.functions.stage import staged
from signaldeck.operators import issues as I
from signaldeck.operators import lookup as J
from signaldeck.operators import ordered as O
from signaldeck.schema import RECORD_DDL, event_ms
from signaldeck.session import LineageCut
from signaldeck.sources.archive import write_archive
from signaldeck.sources.snapshots import Archive
from signaldeck.streaming.state import DeltaState

# Executors get the state handler itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEDUPE_KEYS = ["project_id", "source", "source_id"]


def stream_records(spark: SparkSession, path: str, schema: str = RECORD_DDL, format: str = "parquet",
                   **options: str) -> DataFrame:
    """Continuous intake of files as they arrive.

    ``schema`` is the record table by default; pass a request schema (for example of an
    export batch or a span payload) and apply the batch flattening operators to the
    result.  For a broker use its format name and options, where its package is present.
    """
    reader = spark.readStream.schema(schema).format(format)
    return reader.options(**options).load(path)


def stream_dedupe(records: DataFrame) -> DataFrame:
    """One record per source id, whatever its age; records without a source id all pass.

    The state store remembers every source id.  :func:`dedupe_upsert` keeps them in a
    table instead and reads the parts of it that a batch touches.
    """
    keyed = records.filter(F.col("source_id").isNotNull()).dropDuplicates(DEDUPE_KEYS)
    return keyed.unionByName(records.filter(F.col("source_id").isNull()))


KEY_BUCKETS = 64


def _latest_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DEDUPE_KEYS).agg(F.max("at").alias("at"), F.max_by("released", "at").alias("released"))


def key_state(spark: SparkSession, path: str, buckets: int = KEY_BUCKETS) -> DeltaState:
    """Source ids that a :func:`dedupe_upsert` under ``path`` knows; released ones are marked."""
    return DeltaState(spark, f"{path}/keys", DEDUPE_KEYS, _latest_keys, buckets)


def dedupe_upsert(path: str, buckets: int = KEY_BUCKETS) -> Callable[..., None]:
    """``foreachBatch`` function: first copies to ``rows/batch=n``, their keys to a state under ``keys``.

    No record is dropped for its age.  A batch reads the hash buckets that its own keys
    fall into; a replayed batch writes the same rows again.  The number of buckets is that
    of the first batch.  ``keys`` may give the key columns of the batch from a table that
    is cheaper to read.
    """

    def upsert(batch: DataFrame, batch_id: int, keys: DataFrame | None = None) -> None:
        spark = batch.sparkSession
        state = key_state(spark, path, buckets)
        keyed = batch.filter("source_id IS NOT NULL")
        rows, cut = O.dedupe(keyed), None
        if any(v < (batch_id, 0) for v in state.versions()):
            # The batch's keys are written once: the batch itself would be read whole for each use.
            cut = LineageCut(spark)
            keys = cut.save((keyed if keys is None else keys.filter("source_id IS NOT NULL")).select(*DEDUPE_KEYS).distinct())
            known = state.before(batch_id, state.touched(keys)).filter("NOT released").join(keys, DEDUPE_KEYS, "left_semi")
            rows = rows.join(known, DEDUPE_KEYS, "left_anti").select(*batch.columns)
        # Records without a source id meet no join: there they would all have one key.
        rows = rows.unionByName(batch.filter("source_id IS NULL"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        if cut is not None:
            cut.clear()
        written = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={batch_id}")
        fresh = written.filter("source_id IS NOT NULL").select(*DEDUPE_KEYS, F.lit(2 * batch_id).cast("bigint").alias("at"), F.lit(False).alias("released"))
        state.update(fresh, batch_id)

    return upsert


def release_keys(spark: SparkSession, path: str, evicted: DataFrame) -> None:
    """Forget the source ids of evicted records, between two batches: what arrives with them again is new."""
    state = key_state(spark, path)
    versions = state.versions()
    if versions:
        keys = evicted.filter("source_id IS NOT NULL").select(*DEDUPE_KEYS).distinct()
        at = F.lit(2 * versions[-1][0] + 1).cast("bigint")
        state.amend(keys.withColumns({"at": at, "released": F.lit(True)}))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it doesn't exist."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def new_records(batch: DataFrame, stored: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Accepted rows of a micro-batch: active project, first copy, not stored before."""
    active = batch if projects is None else J.active_only(batch, projects)
    return J.new_only(O.dedupe(active), stored)


# --- counter differencing ----------------------------------------------------------

STREAM_SCHEMA, STATE_SCHEMA = "stream string", "last_ts bigint, start bigint, previous double"
READING_BUCKETS = 1024
# Readings without a start come last at an instant.
NO_START = 2**63 - 1


class CounterDifference(StatefulProcessor):
    """Last accepted readings of the counter streams of a bucket, kept across batches and restarts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState("readings", STREAM_SCHEMA, STATE_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        # The readings of one bucket within one micro-batch, stream by stream.
        batch = pd.concat(list(rows)).sort_values(["stream_key", "ts_nano", "stream_start", "id"], kind="stable")
        deltas, flags = [], []
        stream = state = None
        for of, now, start, reading, monotonic in zip(
            batch["stream_key"], batch["ts_nano"], batch["stream_start"].replace(NO_START, 0), batch["value"], batch["monotonic"]
        ):
            if of != stream:
                self._keep(stream, state)
                stream, state = of, self._state.getValue((of,))
            start, now, reading = int(start), int(now), float(reading)
            delta, violation = None, False
            if state is None or now > state[0]:
                if state is not None and start != state[1]:
                    delta = reading
                elif state is not None:
                    violation = bool(monotonic) and reading < state[2]
                    delta = None if violation else reading - state[2]
                if not violation:
                    state = (now, start, reading)
            deltas.append(delta)
            flags.append(violation)
        self._keep(stream, state)
        yield batch.assign(
            cumulative_value=batch["value"], value=pd.Series(deltas, batch.index, dtype="float64"),
            violation=pd.Series(flags, batch.index, dtype="bool"),
        )

    def _keep(self, stream: str | None, state: tuple | None) -> None:
        if stream is not None:
            self._state.updateValue((stream,), state)

    def close(self) -> None:
        pass


def stream_difference(readings: DataFrame, buckets: int = READING_BUCKETS) -> DataFrame:
    """Incremental counter differencing; a reading not later than the last gets no value.

    Input: cumulative sum records with a value and a stream id.  Needs the RocksDB state
    store.  The delta of a row depends on arrival order between batches; the batch
    operator recomputes from history instead.  Streams are handled by hash bucket, so that
    the cost of a call is shared by many; a checkpoint keeps to its number of ``buckets``.
    All readings of a bucket in one micro-batch meet in one task: bound the batch
    (maxFilesPerTrigger, maxBytesPerTrigger), or use :func:`difference_upsert`, which
    spreads a hot stream over ranges.
    """
    # pandas reads BIGINT with nulls as DOUBLE: such columns travel as text.
    whole = [name for name, kind in readings.dtypes if kind == "bigint" and name != "ts_nano"]
    packed = readings.withColumns({name: F.col(name).cast("string") for name in whole}).withColumns({
        "fields": F.to_json("fields"), "violation": F.lit(False), "stream_key": F.to_json(F.struct(*O.STREAM), {"ignoreNullFields": "false"}),
        "stream_start": F.coalesce(F.col("start_nano").cast("bigint"), F.lit(NO_START)),
    })
    packed = packed.withColumn("stream_bucket", F.pmod(F.xxhash64("stream_key"), F.lit(buckets).cast("bigint")))
    out = packed.groupBy("stream_bucket").transformWithStateInPandas(
        CounterDifference(), packed.schema, "Append", "None"
    )
    out = out.withColumns({name: F.col(name).cast("bigint") for name in whole})
    return out.withColumn("fields", F.parse_json("fields")).drop("stream_key", "stream_start", "stream_bucket")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store needed by :func:`stream_difference`."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# --- per-batch state -----------------------------------------------------------------

def issue_states(spark: SparkSession, path: str) -> DeltaState:
    return DeltaState(spark, path, ["project_id", "issue_id"], I.merge_issue_state)


def issue_upsert(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps the issue rollup under ``path``.

    A batch writes the rollup of its own errors; :func:`stored_issues` adds them up.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        errors = batch.filter("signal = 'error'")
        # Staged: the filter on the id would compute it a second time.
        errors = staged(errors, issue_id=ids.issue_id(F.col("issue_title"), F.col("issue_fingerprint")))
        issue_states(batch.sparkSession, path).update(I.issue_state(errors), batch_id)

    return upsert


def release_issues(spark: SparkSession, path: str, evicted: DataFrame) -> None:
    """Take evicted error records out of the retained counts and latest ids, between two batches."""
    issue_states(spark, path).amend(I.evicted_state(I.with_issue_id(evicted)))


def stored_issues(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """Issue table after a batch, by default the newest one."""
    return I.issue_rows(issue_states(spark, path).read(batch_id))


def difference_upsert(path: str, parts: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that differences counters with state under ``path``.

    Batch n writes its rows to ``rows/batch=n`` and the last accepted readings of its own
    streams to the state; a replayed batch writes both again from the state before it.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = DeltaState(spark, f"{path}/state", O.STREAM, O.latest_state)
        state = states.before(batch_id, states.touched(batch))
        cut = LineageCut(spark, keep_all=True)
        rows, _ = O.difference_batch(batch, state, parts, cut)
        target = f"{path}/rows/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        cut.clear()
        written = spark.read.schema(rows.schema).parquet(target)
        states.update(O.next_state(written), batch_id)

    return upsert


def change_log(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: one (project, signal, sequence) per batch that had rows."""

    def append(batch: DataFrame, batch_id: int) -> None:
        changes = batch.select("project_id", "signal").distinct()
        changes.withColumn("sequence", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return append


# --- aggregates and sinks ---------------------------------------------------------------

def series_upsert(path: str, interval_ms: int, start_ms: int = 0, group: list[str] | None = None,
                  by_value: bool = False) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: partial aggregates of a batch's samples to ``batch=n``.

    Intervals are aligned to ``start_ms``.  Samples may be late by any time and intervals
    stay open: :func:`stored_series` adds up what has come so far.  With ``by_value`` the
    partials count samples per value (:func:`stored_value_counts`), from which
    :func:`signaldeck.operators.metrics.percentile_of_counts` takes exact percentiles.
    """
    keys = ["bucket_ms", "name", *(group or []), *(["value"] if by_value else [])]

    def append(batch: DataFrame, batch_id: int) -> None:
        inside = F.pmod(event_ms() - F.lit(start_ms), F.lit(interval_ms).cast("bigint"))
        samples = batch.filter(F.col("value").isNotNull()).withColumn("bucket_ms", event_ms() - inside)
        count = F.count(F.lit(1))
        extremes = [F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")]
        parts = [count.alias("samples")] if by_value else [count.alias("count"), *extremes]
        samples.groupBy(*keys).agg(*parts).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return append


def stored_series(spark: SparkSession, path: str, group: list[str] | None = None) -> DataFrame:
    """Sums, counts and extremes per interval over all batches so far, open intervals included."""
    rows = spark.read.parquet(path).groupBy("bucket_ms", "name", *(group or []))
    return rows.agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def stored_value_counts(spark: SparkSession, path: str, group: list[str] | None = None) -> DataFrame:
    """Samples per interval and value over all batches so far."""
    rows = spark.read.parquet(path).groupBy("bucket_ms", "name", *(group or []), "value")
    return rows.agg(F.sum("samples").alias("samples"))


def stream_counters(records: DataFrame) -> DataFrame:
    """Running accepted totals per signal (update or complete mode)."""
    return records.groupBy(F.concat(F.lit("accepted."), "signal").alias("name")).agg(
        F.count(F.lit(1)).alias("value")
    )


def observed(records: DataFrame, name: str = "accepted") -> DataFrame:
    """Attach accepted totals to the progress events of a stream at no extra pass."""
    totals = [F.count(F.lit(1)).alias("accepted")] + [
        F.count_if(F.col("signal") == signal).alias(f"accepted_{signal}")
        for signal in ("error", "log", "metric", "trace")
    ]
    return records.observe(name, *totals)


def archive_upsert(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a batch's records to the archive layout under ``batch=n``.

    Rows are gathered by partition first, so that a batch writes few files; a replayed
    batch overwrites its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_archive(batch, f"{path}/batch={batch_id}", "overwrite")

    return write


def archive_commit(archive: Archive, name: str = "stream", merge_below: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: each batch is one commit of the archive, a replayed one is none.

    With ``merge_below``, files of fewer records are merged after every 16th batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        archive.append(batch, f"{name}/{batch_id}")
        if merge_below is not None and batch_id % 16 == 15:
            archive.merge_small(merge_below)

    return write


def run_available(writer: DataStreamWriter, checkpoint: str | None = None) -> None:
    """Process everything that has arrived, then stop."""
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


