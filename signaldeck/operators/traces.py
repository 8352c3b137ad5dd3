"""Trace trees: spans in pre-order with depth, for traces of any size and shape.

Spans are numbered in (trace, time, id) order over range partitions, so that a number
tells the partition of its span.  The tour that enters and leaves every span gives a list:
the entries before a span's own are its position, those not left again its depth.  The
list is ranked in two steps.  Each partition shortens the stretches that lie in it, a
chunk of spans at a time; what is left are the pointers between chunks, and only their targets are ranked by pointer
doubling.  Range bounds cut through few small traces; a huge one is spread over many
partitions like any other rows.  Spans the tour does not reach hang on cycles, which are
opened at the span that precedes all its ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signaldeck.session import LineageCut

TRACE = ["project_id", "trace_id"]
# Rows of a partition are numbered from its own start.
PARTITION_BITS = 33
# Where the tour begins, and what stands for a span without an end of its list.
START, LOOP = -1, -2
# Spans whose lists are shortened at once: what a task holds doesn't grow with its rows.
CHUNK = 1 << 18


def _numbered(spans: DataFrame, keys: list[str], ranges: int | None) -> DataFrame:
    """One row per record: keys, id, span_id, up and ``n``, which rises in (keys, ts, id) order."""
    thin = spans.select(*keys, "id", F.col("ts_nano").alias("ts"), "span_id", F.col("parent_span_id").alias("up"))
    order = [*keys, "ts", "id"]
    placed = thin.dropDuplicates([*keys, "id"]).repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    return LineageCut(spans.sparkSession).save(placed.withColumn("n", F.monotonically_increasing_id()).drop("ts"))


def _parents(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the parent's number; NULL for roots and orphans."""
    # Should two records share a span id, children belong to the earlier one.
    owners = numbered.filter(F.col("span_id").isNotNull()).groupBy(*keys, F.col("span_id").alias("up")).agg(F.min("n").alias("parent"))
    return numbered.select(*keys, "n", "up").join(owners, [*keys, "up"], "left").select(*keys, "n", "parent")


def _with_elder(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``elder``, the number before this one under the same parent or among the trace's roots.

    A parent with very many children is cut at range bounds; the first child of a range
    goes on from the last one of the range before, from a table with a row for both.
    """
    group = [*keys, "parent"]
    part = [*group, "_range"]
    ranged = nodes.repartitionByRange(*group, "late", "n").withColumn("_range", F.spark_partition_id())
    ranged = LineageCut(nodes.sparkSession).save(ranged)
    inside = F.lag("n").over(W.partitionBy(*part).orderBy("late", "n"))
    lasts = ranged.groupBy(*part).agg(F.max(F.struct("late", "n")).getField("n").alias("_last"))
    before = F.lag("_last").over(W.partitionBy(*group).orderBy("_range"))
    handed = lasts.withColumn("_before", before).filter(F.col("_before").isNotNull()).select(*[F.col(c).alias(f"_h_{c}") for c in part], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in part]
    rows = ranged.withColumn("_inside", inside).join(handed, same, "left")
    return rows.select("n", "parent", F.coalesce("_inside", "_before").alias("elder"))


def _event(number: Column, leave: int) -> Column:
    return number * 2 + leave


def _tour(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """n, and the events before entering it (``enter``) and before leaving it (``leave``)."""
    linked = _with_elder(nodes, keys)
    youngest = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("n")).agg(F.max("n").alias("child"))
    return linked.join(youngest, "n", "left").select(
        "n",
        F.coalesce(_event(F.col("elder"), 1), _event(F.col("parent"), 0), F.lit(START)).alias("enter"),
        F.coalesce(_event(F.col("child"), 1), _event(F.col("n"), 0)).alias("leave"),
    )


def _shorten(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Follow each event's list through about ``chunk`` rows at a time, by doubling.

    Gives, for both events of a span, the entries passed, the depth gained and the event of
    another chunk that comes next (``START`` at the list's begin, ``LOOP`` for none).
    """
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= chunk:
            yield from _shorten_rows(pa.Table.from_batches(held))
            held, rows = [], 0
    if held:
        yield from _shorten_rows(pa.Table.from_batches(held))


def _shorten_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    n, enter, leave = (table.column(c).to_numpy() for c in ("n", "enter", "leave"))
    rank = np.argsort(n, kind="stable")
    n, before = n[rank], np.stack([enter[rank], leave[rank]], 1).reshape(-1)
    at = np.minimum(np.searchsorted(n, before >> 1), len(n) - 1)
    here = (n[at] == before >> 1) & (before >= 0)
    # The place, among the rows' events, of the event before; -1 where it lies elsewhere.
    place = np.where(here, 2 * at + (before & 1), -1)
    far = np.where(here, LOOP, before)
    # What the event before adds: an entry and a level, or a level back.
    left = before & 1
    passed, depth = np.where(before >= 0, 1 - left, 0), np.where(before >= 0, 1 - 2 * left, 0)
    for _ in range(len(place).bit_length()):
        some = np.flatnonzero(place >= 0)
        if not len(some):
            break
        to = place[some]
        passed[some], depth[some] = passed[some] + passed[to], depth[some] + depth[to]
        far[some], place[some] = far[to], place[to]
    names = ["n", "enter", "enter_passed", "enter_depth", "leave", "leave_passed", "leave_depth"]
    columns = [n, *(x[side::2] for side in (0, 1) for x in (far, passed, depth))]
    for start in range(0, len(n), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 50_000]) for c in columns], names=names)


SHORTENED = "n bigint, enter bigint, enter_passed bigint, enter_depth bigint, leave bigint, leave_passed bigint, leave_depth bigint"


def _rank_targets(shortened: DataFrame) -> DataFrame:
    """event, passed, depth of every event that another chunk points to; those on loops are left out."""
    targets = shortened.select(F.explode(F.array("enter", "leave")).alias("event")).filter(F.col("event") >= 0).distinct()
    own = shortened.withColumn("n2", F.col("n"))
    rows = targets.withColumn("n2", F.shiftright("event", 1)).join(own.drop("n"), "n2")
    side = lambda c: F.when(F.col("event") % 2 == 0, F.col(f"enter{c}")).otherwise(F.col(f"leave{c}"))
    rounds = LineageCut(shortened.sparkSession)
    ranked = rounds.save(rows.select("event", side("").alias("next"), side("_passed").alias("passed"), side("_depth").alias("depth")))
    still = None
    while (open_ := ranked.filter(F.col("next") >= 0).count()) and open_ != still:
        further = ranked.select(F.col("event").alias("next"), F.col("next").alias("_next"), F.col("passed").alias("_passed"), F.col("depth").alias("_depth"))
        jumped = ranked.filter(F.col("next") >= 0).join(further, "next").select(
            "event", F.col("_next").alias("next"), (F.col("passed") + F.col("_passed")).alias("passed"), (F.col("depth") + F.col("_depth")).alias("depth")
        )
        # Loops never end: they are what is left once a round brings no event to an end.
        still = open_
        ranked = rounds.save(ranked.filter(F.col("next") < 0).unionByName(jumped))
    return ranked.filter(F.col("next") == START).select("event", "passed", "depth")


def _positions(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """n, position and depth; both NULL for spans on cycles and below them."""
    spark = nodes.sparkSession
    tour = _tour(nodes, keys).withColumn("_part", F.shiftright("n", PARTITION_BITS))
    # Neighbours in number are mostly neighbours in the list.
    dealt = tour.repartition("_part").sortWithinPartitions("n")
    shortened = dealt.select("n", "enter", "leave").mapInArrow(_shorten, SHORTENED)
    shortened = LineageCut(spark).save(shortened)
    targets = _rank_targets(shortened).withColumnRenamed("event", "enter")
    targets = LineageCut(spark).save(targets)
    begun = F.col("enter") == START
    joined = shortened.select("n", "enter", "enter_passed", "enter_depth").join(targets, "enter", "left")
    add = lambda own, more: F.when(begun, F.col(own)).otherwise(F.col(own) + F.col(more))
    return joined.select("n", add("enter_passed", "passed").alias("position"), add("enter_depth", "depth").alias("depth"))


def _open_cycles(looping: DataFrame) -> DataFrame:
    """Numbers of the spans that precede all their ancestors; ``looping`` has n and parent of spans without a root."""
    rounds = LineageCut(looping.sparkSession)
    state = rounds.save(looping.select("n", F.col("parent").alias("up"), F.col("parent").alias("best"), F.lit(True).alias("moved")))
    while not state.filter("moved").isEmpty():
        further = state.select(F.col("n").alias("up"), F.col("up").alias("_up"), F.col("best").alias("_best"))
        state = rounds.save(
            state.join(further, "up").select(
                "n", F.col("_up").alias("up"), F.least("best", "_best").alias("best"), (F.col("_best") < F.col("best")).alias("moved")
            )
        )
    return state.filter("n <= best").select("n")


def trace_tree(spans: DataFrame, keys: list[str] = TRACE, ranges: int | None = None) -> DataFrame:
    """Spans of each trace in pre-order: columns keys, id, depth, position (from 0).

    ``ranges`` sets the number of range partitions; Spark chooses it by default.

    Records count once per id.  A span whose parent is not in the trace is a root;
    siblings are ordered by (time, id); spans on cycles follow, the earliest as a root.
    """
    spark = spans.sparkSession
    numbered = _numbered(spans, keys, ranges)
    nodes = LineageCut(spark).save(_parents(numbered, keys).withColumn("late", F.lit(0)))
    placed = LineageCut(spark).save(_positions(nodes, keys))
    lost = placed.filter(F.col("position").isNull()).select("n")
    if not lost.isEmpty():
        looping = LineageCut(spark).save(nodes.join(lost, "n", "left_semi"))
        starts = _open_cycles(looping).withColumn("_start", F.lit(True))
        # Traces with a cycle are ordered anew, with the opened spans behind their roots.
        again = nodes.join(looping.select(*keys).distinct(), keys, "left_semi").join(starts, "n", "left")
        opened = F.col("_start").isNotNull()
        again = again.withColumns({"parent": F.when(~opened, F.col("parent")), "late": F.when(opened, 1).otherwise(0)}).drop("_start")
        again = LineageCut(spark).save(again)
        rest = placed.join(again.select("n"), "n", "left_anti")
        placed = rest.unionByName(LineageCut(spark).save(_positions(again, keys)))
    return numbered.select(*keys, "id", "n").join(placed, "n").select(*keys, "id", "depth", "position")
