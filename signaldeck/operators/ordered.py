"""Order-dependent operators: counter differencing, de-duplication, eviction plans.

No operator here sends all rows of a key to one task.  Long sequences are cut into
ranges; each is processed on its own, and the few values that one hands to the next
travel through a summary with one row per range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signaldeck.operators.counters import difference_in_ranges
from signaldeck.schema import int_div
from signaldeck.session import LineageCut

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
STREAM = ["project_id", "source", "stream_id"]


def is_cumulative() -> Column:
    """Records that carry a cumulative counter reading."""
    return F.coalesce(
        (F.col("signal") == "metric")
        & (F.col("type") == "sum")
        & (F.col("temporality") == "cumulative"),
        F.lit(False),
    )


READING = {"signal": "metric", "type": "sum", "temporality": "cumulative"}


def is_reading() -> Column:
    """Filter for cumulative readings with a value and a stream, in terms that reach a Parquet scan."""
    usable = F.col("value").isNotNull() & F.col("stream_id").isNotNull()
    for name, wanted in READING.items():
        usable = (F.col(name) == wanted) & usable
    return usable


def is_no_reading() -> Column:
    """Filter for all other records, in such terms too."""
    other = F.col("value").isNull() | F.col("stream_id").isNull()
    for name, wanted in READING.items():
        other = F.col(name).isNull() | (F.col(name) != wanted) | other
    return other


def difference_cumulative(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Turn cumulative counter readings into deltas, recomputed from full history.

    Per (project, source, stream) in (time, start, id) order: the first reading is a
    baseline without a value; a new start time is a reset whose value is the reading
    itself; otherwise the value is the difference to the last accepted reading.  A
    decrease of a monotonic counter is flagged in ``violation``, gets no value and is
    not accepted.  A reading at the time of the last accepted one is late: no value, no
    effect.  The reading moves to ``cumulative_value``; other records pass.

    Streams are spread over range partitions, ``parts`` of them or Spark's own number.
    """
    counter = is_cumulative()
    others = records.filter(~counter).withColumn("violation", F.lit(False))
    # A reading without a numeric value or without a stream only loses its value.
    usable = F.col("value").isNotNull() & F.col("stream_id").isNotNull()
    loose = (
        records.filter(counter & ~usable)
        .withColumn("cumulative_value", F.coalesce("value", "cumulative_value"))
        .withColumn("value", F.lit(None).cast("double"))
        .withColumn("violation", F.lit(False))
    )
    readings = records.filter(counter & usable)
    differenced = _difference(readings, None, parts).drop("accepted")
    return others.unionByName(loose).unionByName(differenced)


# Last accepted reading per stream, as kept between batches.
STATE_DDL = (
    "project_id bigint, source string, stream_id string, last_nano bigint, start bigint, "
    "previous double, monotonic boolean"
)


def difference_batch(readings: DataFrame, state: DataFrame | None = None, parts: int | None = None,
                     cut: LineageCut | None = None) -> tuple[DataFrame, DataFrame]:
    """Difference one batch of readings after ``state``; returns (rows, next state).

    Readings need a value and a stream id.  One not later than the state's last accepted
    reading gets no value.  The state enters as one more reading in front of the batch,
    so a stream that fills the whole batch is still spread.  Both results must be written before the next batch; ``rows`` keeps an ``accepted`` flag.
    Tables that the results are read from are saved by ``cut``, by default until the application ends.
    """
    rows = _difference(readings, state, parts, cut)
    return rows, next_state(rows, state)


def next_state(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State after a differenced batch: per stream the latest accepted reading."""
    last = F.struct(
        F.col("ts_nano").alias("last_nano"),
        F.coalesce("start_nano", F.lit(0).cast("bigint")).alias("start"),
        F.col("cumulative_value").alias("previous"),
        F.coalesce("monotonic", F.lit(False)).alias("monotonic"),
    )
    known = rows.filter("accepted").select(*STREAM, last.alias("_s")).select(*STREAM, "_s.*")
    return latest_state(known if state is None else known.unionByName(state))


def latest_state(states: DataFrame) -> DataFrame:
    """Per stream the state of the latest accepted reading."""
    kept = F.struct("last_nano", "start", "previous", "monotonic")
    return states.groupBy(*STREAM).agg(F.max(kept).alias("_s")).select(*STREAM, "_s.*")


# Time of the stored state, before every real reading.
STATE_NANO = -(2**63)


def _difference(readings: DataFrame, state: DataFrame | None, parts: int | None, cut: LineageCut | None = None) -> DataFrame:
    """Readings with delta, ``violation`` and ``accepted``.

    Only keys, times and values go through the ordered scan.  The rows themselves are
    written once with a number, which tells copies apart and joins the outcome to them.
    """
    cut = cut or LineageCut(readings.sparkSession, keep_all=True)
    numbered = cut.save(readings.withColumn("_row", F.monotonically_increasing_id()))
    thin = numbered.select(
        *STREAM, "ts_nano", F.coalesce("start_nano", F.lit(0).cast("bigint")).alias("_start"), "value",
        F.coalesce("monotonic", F.lit(False)).alias("_mono"), "_row", F.struct("id", "value", "_row").alias("_order"),
    )
    if state is not None:
        first = state.select(
            *STREAM, F.lit(STATE_NANO).cast("bigint").alias("ts_nano"), F.col("start").alias("_start"),
            F.col("previous").alias("value"), F.col("monotonic").alias("_mono"), F.lit(None).cast("bigint").alias("_row"),
            F.lit(None).cast(thin.schema["_order"].dataType).alias("_order"),
        )
        thin = _in_time(thin, state).unionByName(first)
    found = difference_in_ranges(thin, STREAM, parts, cut)
    joined = numbered.join(found.withColumnRenamed("violation", "_violation"), "_row", "left")
    return joined.select(
        *[F.col(c) for c in readings.columns if c not in ("value", "cumulative_value")],
        F.col("value").alias("cumulative_value"),
        F.col("delta").alias("value"),
        F.coalesce("_violation", F.lit(False)).alias("violation"),
        F.coalesce("accepted", F.lit(False)).alias("accepted"),
    )


def _in_time(thin: DataFrame, state: DataFrame) -> DataFrame:
    """Readings later than the last accepted one of their stream.

    Only those not later than the newest of all streams are joined with the state.
    """
    newest = state.agg(F.max("last_nano")).first()[0]
    if newest is None:
        return thin
    old = F.coalesce(F.col("ts_nano") <= newest, F.lit(False))
    last = state.select(*STREAM, F.col("last_nano").alias("_last"))
    late = F.coalesce(F.col("ts_nano") <= F.col("_last"), F.lit(False))
    checked = thin.filter(old).join(last, STREAM, "left").filter(~late).select(*thin.columns)
    return thin.filter(~old).unionByName(checked)


def monotonic_violations(differenced: DataFrame) -> DataFrame:
    """Rejected decreases per project."""
    return differenced.filter("violation").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("violations")
    )


def dedupe(records: DataFrame) -> DataFrame:
    """One record per (project, source, source id): earliest arrival, then earliest event.

    ``row_number() = 1`` is also applied before the shuffle (window group limit), so a
    group of copies is cut to one row per task.  Records without source id all stay.
    """
    first = W.partitionBy("project_id", "source", "source_id").orderBy(
        "received_at_ms", "ts_nano", "id"
    )
    keyed = (
        records.filter(F.col("source_id").isNotNull())
        .withColumn("_copy", F.row_number().over(first))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )
    return keyed.unionByName(records.filter(F.col("source_id").isNull()))


def with_prior_total(df: DataFrame, time_ms: str, order: list[str], amount: str,
                     slice_ms: int = HOUR_MS) -> DataFrame:
    """Add ``prior``: the sum of ``amount`` over all rows earlier in (time, order), and
    ``total``: the sum over all rows.

    Two levels: totals per time slice (one small row each) are prefix-summed, and only
    the rows of one slice share a window.
    """
    sliced = df.withColumn("_slice", int_div(F.col(time_ms), slice_ms))
    by_slice = W.orderBy("_slice")
    totals = (
        sliced.groupBy("_slice")
        .agg(F.sum(amount).cast("bigint").alias("_amount"))
        .select(
            "_slice",
            F.coalesce(
                F.sum("_amount").over(by_slice.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("_slice_prior"),
            F.sum("_amount").over(W.partitionBy()).alias("total"),
        )
    )
    inside = (
        W.partitionBy("_slice").orderBy(time_ms, *order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        sliced.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(totals, "_slice")
        .withColumn("prior", (F.col("_slice_prior") + F.col("_inside")).cast("bigint"))
        .drop("_slice", "_slice_prior", "_inside")
    )


def _check_target(target_bytes: int) -> None:
    if target_bytes <= 0:
        raise ValueError("bytes to keep must be positive")


def evict_plan(manifest: DataFrame, target_bytes: int, other_bytes: int = 0) -> DataFrame:
    """Archive partitions to drop, oldest first, until the target holds.

    ``other_bytes`` is what lives outside the archive (hot records, issues).
    """
    _check_target(target_bytes)
    summed = with_prior_total(
        manifest, "min_received_ms", ["project_id", "signal", "receive_date"], "logical_bytes"
    )
    over = F.col("total") + F.lit(other_bytes) - F.col("prior") > target_bytes
    return summed.filter(over).drop("prior", "total")


@dataclass(frozen=True)
class Cut:
    """Last evicted position in (arrival, id, project) order; None evicts nothing."""

    received_at_ms: int
    id: str
    project_id: int

    def evicted(self, time_ms: str = "received_at_ms", id: str = "id") -> Column:
        time, key, project = F.col(time_ms), F.col(id), F.col("project_id")
        return (time <= self.received_at_ms) & (
            (time < self.received_at_ms)
            | (key < self.id)
            | ((key == self.id) & (project <= self.project_id))
        )


CUT_WIDTHS_MS = (30 * DAY_MS, DAY_MS, HOUR_MS, 60_000, 1_000, 1)


def _crossing(groups: DataFrame, key: str, needed: int) -> tuple[object, int] | None:
    """First group (in key order) at which the running total reaches ``needed``, and the
    total before it.  ``groups`` has one small row per key."""
    running = groups.withColumn(
        "_upto", F.sum("_amount").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    )
    row = running.filter(F.col("_upto") >= needed).orderBy(key).limit(1).collect()
    return (row[0][key], row[0]["_upto"] - row[0]["_amount"]) if row else None


def hot_cut(records: DataFrame, target_bytes: int, other_bytes: int = 0,
            size: str = "logical_bytes") -> Cut | None:
    """Where to cut the oldest records so that the rest fits the target.

    The cut is found by narrowing: totals per 30 days, then per day, hour, minute,
    second and millisecond inside the crossing interval.  The rows of that millisecond,
    however many, are cut into ranges by their full key, and only the crossing range is
    put in order.  Every step is a map-side-combined sum over rows that the arrival-time
    bounds prune; no step sorts the table or moves whole rows.
    """
    _check_target(target_bytes)
    thin = records.select("received_at_ms", "id", "project_id", F.col(size).alias("_amount"))
    total = thin.agg(F.sum("_amount")).first()[0] or 0
    needed = total + other_bytes - target_bytes
    if needed <= 0:
        return None
    needed = min(needed, total)
    rows = thin
    for width in CUT_WIDTHS_MS:
        slot = int_div(F.col("received_at_ms"), width)
        groups = rows.groupBy(slot.alias("_slot")).agg(F.sum("_amount").alias("_amount"))
        slot_value, prior = _crossing(groups, "_slot", needed)
        needed -= prior
        rows = rows.filter(
            F.col("received_at_ms").between(slot_value * width, slot_value * width + width - 1)
        )
    keyed = rows.groupBy("id", "project_id").agg(F.sum("_amount").alias("_amount"))
    ranged = keyed.repartitionByRange("id", "project_id").withColumn("_range", F.spark_partition_id())
    ranged = LineageCut(records.sparkSession, keep_all=True).save(ranged)
    groups = ranged.groupBy("_range").agg(F.sum("_amount").alias("_amount"))
    number, prior = _crossing(groups, "_range", needed)
    inside = ranged.filter(F.col("_range") == number).withColumn("_key", F.struct("id", "project_id"))
    (identifier, project), _ = _crossing(inside, "_key", needed - prior)
    return Cut(int(slot_value), identifier, project)


def evict_hot(records: DataFrame, target_bytes: int, other_bytes: int = 0,
              size: str = "logical_bytes") -> DataFrame:
    """Oldest records by (arrival, id) to drop until the target holds."""
    cut = hot_cut(records, target_bytes, other_bytes, size)
    return records.filter(F.lit(False) if cut is None else cut.evicted())


def evict_issues(issues: DataFrame, target_bytes: int, other_bytes: int = 0,
                 size: str = "logical_bytes") -> DataFrame:
    """Issues to drop, oldest (first seen, id) first, once all records are gone."""
    ordered = issues.select(
        F.col("first_seen_ms").alias("received_at_ms"), F.col("issue_id").alias("id"), "project_id", size
    )
    cut = hot_cut(ordered, target_bytes, other_bytes, size)
    return issues.filter(F.lit(False) if cut is None else cut.evicted("first_seen_ms", "issue_id"))
