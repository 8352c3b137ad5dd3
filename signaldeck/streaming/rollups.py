"""Metric samples rolled up by hour and by day as they arrive, and series that read the rollups.

A batch adds partial aggregates of its own samples to both tiers, and on request counts
per value, from which percentiles stay exact.  Late samples are added like others, so
no period closes.  A series takes whole days that lie within one of its intervals from
the day tier, whole hours from the hour tier, and only what is left from the records.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.operators import metrics as M
from signaldeck.operators import search
from signaldeck.schema import event_ms, int_div
from signaldeck.session import LineageCut
from signaldeck.streaming.state import DeltaState

# Period -> what a bucket of stored periods spans; the longest period comes first.
TIERS = {M.DAY: 32 * M.DAY, M.HOUR: M.DAY}
IDENTITY = ["project_id", "name", "type", "unit"]

Range = tuple[int, int]


def _down(time: Column, length: int) -> Column:
    return time - F.pmod(time, F.lit(length).cast("bigint"))


def _within(time: Column, query: M.MetricQuery, length: int) -> Column:
    """Whether the period of a time lies within one interval of the query, and within its range."""
    first = M.bucket(time, query.start_ms, query.step_ms)
    end = F.least(first + query.step_ms, F.lit(query.end_ms + 1).cast("bigint"))
    period = _down(time, length)
    return (period >= first) & (period + length <= end)


def tier_of(time: Column, query: M.MetricQuery) -> Column:
    """Length of the period that answers for a time of the range: the longest that fits, 0 for the records."""
    chosen = F.lit(0)
    for length in reversed(TIERS):
        chosen = F.when(_within(time, query, length), F.lit(length)).otherwise(chosen)
    return chosen


def left_over(query: M.MetricQuery, length: int) -> list[Range]:
    """Half-open ranges that hold all times which no whole period of a length answers for.

    They only prune what is read (:func:`tier_of` decides): beyond the usual number of
    intervals, and where these begin within periods, the whole range is given.
    """
    start, step, end = query.start_ms, query.step_ms, query.end_ms + 1
    if start % length == 0 and step % length == 0:
        edges = [start, end]
    elif (end - start) // step > M.TARGET_POINTS:
        return [(start, end)]
    else:
        edges = [*range(start, end, step), end]
    found: list[Range] = []
    for low, high in zip(edges, edges[1:]):
        first, last = -(-low // length) * length, high // length * length
        for a, b in [(low, first), (last, high)] if first < last else [(low, high)]:
            if a < b and found and found[-1][1] == a:
                found[-1] = (found[-1][0], b)
            elif a < b:
                found.append((a, b))
    return found


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class MetricRollups:
    """Rollups of metrics under a folder, by project, name, type, unit and the given fields.

    With ``by_value`` the values of a period are counted too, as percentiles need it.
    """

    def __init__(self, spark: SparkSession, path: str, group_by: tuple[str, ...] = (), by_value: bool = True) -> None:
        self._spark, self._fields, self._by_value = spark, group_by, by_value
        self._groups = [f"group_{i}" for i in range(len(group_by))]
        # Rollups by other fields lie elsewhere and can't be read by mistake.
        self._path = f"{path}/{hashlib.md5(json.dumps(group_by).encode()).hexdigest()}"

    def _keys(self, by_value: bool) -> list[str]:
        return [*IDENTITY, *self._groups, *(["value"] if by_value else [])]

    def _merged(self, rows: DataFrame, keys: list[str], by_value: bool) -> DataFrame:
        counts = [F.sum("samples").alias("samples")]
        return rows.groupBy(*keys).agg(*(counts if by_value else M.combine()))

    def _state(self, length: int, by_value: bool) -> DeltaState:
        keys = [*self._keys(by_value), "start_ms"]
        return DeltaState(
            self._spark, f"{self._path}/{'values' if by_value else 'parts'}-{length}", keys,
            lambda rows: self._merged(rows, keys, by_value), place=int_div(_down(F.col("start_ms"), TIERS[length]), TIERS[length]),
        )

    def _parts(self, records: DataFrame, time: str, at: Column, by_value: bool) -> DataFrame:
        rows = records.select(
            *IDENTITY, *[M.group_key(field).alias(key) for field, key in zip(self._fields, self._groups)],
            at.alias(time), "value", "ts_nano", "id",
        )
        keys = [*self._keys(False), time]
        if by_value:
            return M.value_counts(rows, keys)
        return rows.groupBy(*keys).agg(*M.partials())

    def upsert(self) -> Callable[[DataFrame, int], None]:
        """``foreachBatch`` function that adds the metric records of a batch; a replayed batch counts once.

        A tier is written from the one below it: the records are read once for each kind.
        """

        def add(batch: DataFrame, batch_id: int) -> None:
            samples = batch.filter(F.col("signal") == "metric")
            for by_value in [False, True] if self._by_value else [False]:
                keys = [*self._keys(by_value), "start_ms"]
                hours = self._parts(samples, "start_ms", _down(event_ms(), M.HOUR), by_value)
                self._state(M.HOUR, by_value).update(hours, batch_id)
                own = self._state(M.HOUR, by_value).run(batch_id)
                days = own.withColumn("start_ms", _down(F.col("start_ms"), M.DAY))
                self._state(M.DAY, by_value).update(self._merged(days, keys, by_value), batch_id)

        return add

    def _stored(self, query: M.MetricQuery, length: int, by_value: bool) -> DataFrame:
        longer = [n for n in TIERS if n > length]
        ranges = left_over(query, longer[-1]) if longer else [(query.start_ms, query.end_ms + 1)]
        span = TIERS[length]
        within = _any([F.col("bucket").between(a // span, b // span) for a, b in ranges])
        rows = self._state(length, by_value).read(within=within)
        if rows is None:
            raise M.MetricError("no rollups by these fields have been stored")
        start = F.col("start_ms")
        rows = rows.filter(start.between(query.start_ms, query.end_ms) & (tier_of(start, query) == length))
        rows = rows.filter((F.col("project_id") == query.project_id) & (F.col("name") == query.name))
        rows = M.of_identity(rows, query)
        return rows.withColumn("bucket_ms", M.bucket(start, query.start_ms, query.step_ms)).drop("start_ms")

    def _read(self, records: DataFrame, query: M.MetricQuery, by_value: bool) -> DataFrame:
        """Partial rows of all tiers and the rest of the records by the query's intervals."""
        pruned = _any([search.time_range(a, b - 1) for a, b in left_over(query, min(TIERS))])
        rest = M.metric_records(records.filter(pruned), query).filter(tier_of(event_ms(), query) == 0)
        rows = self._parts(rest, "bucket_ms", M.bucket(event_ms(), query.start_ms, query.step_ms), by_value)
        for length in TIERS:
            rows = rows.unionByName(self._stored(query, length, by_value))
        return rows

    def series(self, records: DataFrame, query: M.MetricQuery, max_points: int | None = None,
               truncate: bool = False) -> DataFrame:
        """:func:`signaldeck.operators.metrics.metric_series` of records that the rollups hold too.

        ``records`` may be hot and archived rows together; what whole hours or days answer
        for is not read from them.  The query groups by fields of the rollups and has no
        predicate of its own.
        """
        if query.predicate is not None:
            raise M.MetricError("rollups cannot be searched by a predicate")
        missing = [name for name in query.group_by if name not in self._fields]
        if missing:
            raise M.MetricError(f"the rollups are not kept by {', '.join(missing)}")
        by_value = query.aggregate in M.PERCENTILES
        if by_value and not self._by_value:
            raise M.MetricError("the rollups hold no counts per value")
        # Written, as the identity and the series both come from it.
        rows = LineageCut(self._spark).save(self._read(records, query, False))
        metric_type, _ = M.one_identity(rows.groupBy("type", "unit").agg(F.sum("_count").alias("samples")), query)
        own = [self._groups[self._fields.index(name)] for name in query.group_by]
        keys = [f"group_{i}" for i in range(len(own))]
        rest = ["value", "samples"] if by_value else ["_sum", "_count", "_min", "_max", "_latest"]
        rows = self._read(records, query, True) if by_value else rows
        rows = rows.select(*[F.col(a).alias(b) for a, b in zip(own, keys)], "bucket_ms", *rest)
        merged = self._merged(rows, [*keys, "bucket_ms", *(["value"] if by_value else [])], by_value)
        if not by_value:
            merged = merged.filter(F.col("_count") > 0)
        return M.series_of_parts(merged, keys, query, metric_type, max_points, truncate)
