"""Counter readings in order, cut into ranges that are scanned independently.

A range starts without knowing what came before it.  Its first pass therefore reduces the
stream it begins with to a *handover*: what the last accepted reading will be, for every
value that the one before could have.  Handovers, one small row per range, are chained on
the driver; the second pass starts each range with what it was handed.  A range may begin
within an instant: the time of the last accepted reading tells whether the instant is done.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.session import LineageCut

# Last accepted reading: (start, value, time).
State = tuple[int, float, int]


def accept(state: State | None, time: int, start: int, value: float, monotonic: bool) -> tuple[State | None, tuple]:
    """State after a reading, and its (delta, violation, accepted).

    Of one instant the first reading that is no violation is accepted; those behind it are late.
    """
    if state is None:
        return (start, value, time), (None, False, True)
    if time == state[2]:
        return state, (None, False, False)
    if start != state[0]:
        return (start, value, time), (value, False, True)
    if monotonic and value < state[1]:
        return state, (None, True, False)
    return (start, value, time), (value - state[1], False, True)


class Handover:
    """Outcome of a run of readings for any state accepted before their first instant.

    ``other`` is the outcome without a state, or for one with another start than
    ``start``.  For that start it depends on the value before: ``pieces`` are (highest
    value, outcome), in order; above them it is ``rest``, or the state unchanged.
    """

    def __init__(self, start: int | None = None, other: State | None = None,
                 pieces: Iterable[tuple[float, State]] = (), rest: State | None = None) -> None:
        self.start, self.other, self.pieces, self.rest = start, other, list(pieces), rest
        # Pieces of the instant at hand: whatever follows in it is late for them.
        self._fresh: list[tuple[float, State]] = []
        self._time: int | None = None

    def add(self, time: int, start: int, value: float, monotonic: bool) -> None:
        if self.start is None:
            self.start = start
        if time != self._time:
            self.close()
            self._time = time
        self.other, _ = accept(self.other, time, start, value, monotonic)
        self.pieces = [(most, accept(state, time, start, value, monotonic)[0]) for most, state in self.pieces]
        if self.rest is not None:
            self.rest, _ = accept(self.rest, time, start, value, monotonic)
        elif start != self.start or not monotonic:
            self.rest = (start, value, time)
        else:
            below = self._fresh or self.pieces
            if value > (below[-1][0] if below else float("-inf")):
                self._fresh.append((value, (start, value, time)))

    def close(self) -> None:
        """Neighbours with one outcome are one piece."""
        merged: list[tuple[float, State]] = []
        for most, state in [*self.pieces, *self._fresh]:
            if merged and merged[-1][1] == state:
                merged[-1] = (most, state)
            else:
                merged.append((most, state))
        self.pieces, self._fresh = merged, []

    def after(self, state: State | None) -> State | None:
        if self.start is None:
            return state
        if state is None or state[0] != self.start:
            return self.other
        return next((out for most, out in [*self.pieces, *self._fresh] if state[1] <= most), self.rest or state)


class RangeStart:
    """What the first stream of a range makes of the state handed to it."""

    def __init__(self, first: int, whole: Handover, beyond: Handover) -> None:
        # A state of the first instant itself meets only the readings beyond it.
        self.first, self.whole, self.beyond = first, whole, beyond

    @classmethod
    def of(cls, readings: Iterable[tuple[int, int, float, bool]]) -> RangeStart:
        made = None
        for reading in readings:
            made = made or cls(reading[0], Handover(), Handover())
            made.whole.add(*reading)
            if reading[0] != made.first:
                made.beyond.add(*reading)
        made.whole.close()
        made.beyond.close()
        return made

    def after(self, state: State | None) -> State | None:
        at_first = state is not None and state[2] == self.first
        return (self.beyond if at_first else self.whole).after(state)


_STATE = pa.struct([("s", pa.int64()), ("v", pa.float64()), ("t", pa.int64())])
_PIECE = pa.struct([("most", pa.float64()), ("state", _STATE)])
_HANDOVER = pa.struct([("start", pa.int64()), ("other", _STATE), ("pieces", pa.list_(_PIECE)), ("rest", _STATE)])
_SUMMARY = pa.schema(
    [("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("time", pa.int64()), ("whole", _HANDOVER),
     ("beyond", _HANDOVER), ("end", _STATE)]
)
STATE_SQL = "struct<s: bigint, v: double, t: bigint>"
HANDOVER_SQL = f"struct<start: bigint, other: {STATE_SQL}, pieces: array<struct<most: double, state: {STATE_SQL}>>, rest: {STATE_SQL}>"
SUMMARY_SQL = (
    f"part bigint, first string, last string, time bigint, whole {HANDOVER_SQL}, beyond {HANDOVER_SQL}, end {STATE_SQL}"
)


def _packed(state: State | None) -> dict | None:
    return None if state is None else dict(zip("svt", state))


def _packed_handover(hand: Handover) -> dict:
    pieces = [{"most": most, "state": _packed(state)} for most, state in hand.pieces]
    return {"start": hand.start, "other": _packed(hand.other), "pieces": pieces, "rest": _packed(hand.rest)}


def _state(packed) -> State | None:
    return None if packed is None else (packed["s"], packed["v"], packed["t"])


def _handover(packed) -> Handover:
    pieces = [(p["most"], _state(p["state"])) for p in packed["pieces"]]
    return Handover(packed["start"], _state(packed["other"]), pieces, _state(packed["rest"]))


SCAN = ["_part", "_stream", "ts_nano", "_start", "value", "_mono"]


def _readings(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(_values(batch.column(n)) for n in names), strict=True)


def _values(column: pa.Array) -> list:
    """Plain values; by numpy, which is faster, where nulls don't turn whole numbers into others."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def difference_in_ranges(thin: DataFrame, stream: list[str], parts: int | None = None, cut: LineageCut | None = None) -> DataFrame:
    """Deltas of readings (stream columns, ts_nano, _start, value, _mono, _row, _order).

    Returns _row, delta, violation and accepted of those with a _row, a number from 0.  Ranges are cut at bounds that Spark
    samples from the data, also within an instant, so that a stream of any size and a
    burst at one time are spread.  Streams are in order of a hash, which is cheap to
    compare, and named once they are in order; ``cut`` saves the ranges.
    """
    cut = cut or LineageCut(thin.sparkSession, keep_all=True)
    width = [parts] if parts else []
    within = [*stream, "ts_nano", "_start", "_order"]
    hashed = thin.withColumn("_hash", F.xxhash64(*stream))
    ranged = cut.save(hashed.repartitionByRange(*width, "_hash", *within).withColumn("_part", F.spark_partition_id().cast("bigint")))

    def in_order(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("_part").sortWithinPartitions("_hash", "_part", *within)
        # No null, so that no column of the scan holds any: the state's own readings have no row.
        row = F.coalesce("_row", F.lit(-1).cast("bigint")).alias("_row")
        return ordered.withColumn("_stream", F.to_json(F.struct(*stream))).select(*SCAN, row)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of_part in groupby(_readings(batches, SCAN), key=lambda r: r[0]):
            row, last, end = {}, None, None
            for name, own in groupby(of_part, key=lambda r: r[1]):
                if not row:
                    hand = RangeStart.of(r[2:] for r in own)
                    row = {"part": part, "first": name, "time": hand.first}
                    row |= {"whole": _packed_handover(hand.whole), "beyond": _packed_handover(hand.beyond)}
                else:
                    end = None
                    for r in own:
                        end, _ = accept(end, *r[2:])
                last = name
            row |= {"last": last, "end": _packed(end)}
            yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY)

    # A range takes over from others at its first stream and hands over at its last: those between don't count.
    ends = ranged.groupBy("_part").agg(F.min("_hash"), F.max("_hash")).collect()
    outer = ranged.filter(F.col("_hash").isin(sorted({h for _, *both in ends for h in both})))
    given = chained(in_order(outer).mapInArrow(summarise, SUMMARY_SQL).collect())  # one row per range

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, state, held = None, None, []
        for part, stream, time, start, value, monotonic, row in _readings(batches, [*SCAN, "_row"]):
            if (part, stream) != seen:
                name, before = given.get(part, (None, None))
                state = before if name == stream else None
                seen = (part, stream)
            state, out = accept(state, time, start, value, monotonic)
            if row >= 0:
                held.append((row, *out))
            if len(held) > 20_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return in_order(ranged).mapInArrow(scan, "_row bigint, delta double, violation boolean, accepted boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.float64(), pa.bool_(), pa.bool_())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["_row", "delta", "violation", "accepted"])


def chained(summaries: list) -> dict[int, tuple[str, State]]:
    """Part -> (stream, state) that the parts before hand to it."""
    given: dict[int, tuple[str, State]] = {}
    name, state = None, None
    for s in sorted(summaries, key=lambda s: s["part"]):
        if name == s["first"] and state is not None:
            given[s["part"]] = (name, state)
        before = state if name == s["first"] else None
        if s["first"] == s["last"]:
            state = RangeStart(s["time"], _handover(s["whole"]), _handover(s["beyond"])).after(before)
        else:
            state = _state(s["end"])
        name = s["last"]
    return given
