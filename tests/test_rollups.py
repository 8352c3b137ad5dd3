"""Rollups of metrics: equal to the series of the records, and covered records are not read."""

import pytest
from pyspark.sql import functions as F

from helpers import metric, records
from signaldeck.operators import metrics as M
from signaldeck.operators import search
from signaldeck.streaming.rollups import MetricRollups, left_over, tier_of

HOUR, DAY = M.HOUR, M.DAY
NANO = 1_000_000


def request(aggregate, start, end, step, **more):
    return M.MetricQuery(1, "m", aggregate, start, end, interval_ms=step, **more)


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        metric(f"r{n}", (DAY + n * 1_300_017) * NANO, float(n * 37 % 101), fields={"route": "/" + "abc"[n % 3], "zone": n % 2})
        for n in range(400)
    ]
    rows += [{**rows[7], "id": "none", "value": None}, {**rows[9], "id": "log", "signal": "log"}, {**rows[9], "id": "other", "name": "o"}]
    return records(spark, rows).cache()


@pytest.fixture(scope="module")
def rollups(spark, table, tmp_path_factory):
    made = MetricRollups(spark, str(tmp_path_factory.mktemp("rollups")), ("route", "zone"))
    for batch in [0, 1, 2, 2, 3, 4]:  # mixed times, one batch twice
        made.upsert()(table.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == batch), batch)
    return made


def shown(df):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()], key=repr)


SPANS = [(DAY, 7 * DAY, DAY), (DAY + 5 * HOUR, 6 * DAY + 77, 6 * HOUR), (DAY + 12_345, 5 * DAY, 2 * DAY), (0, 4 * DAY, 10 * 60_000), (2 * DAY, 2 * DAY, HOUR)]


@pytest.mark.parametrize("aggregate, start, end, step", [(a, *s) for a, s in zip(["avg", "p90", "p99", "max", "sum"], SPANS)])
def test_equal_to_the_series_of_the_records(table, rollups, start, end, step, aggregate):
    query = request(aggregate, start, end, step, group_by=("route",))
    if start == end:
        with pytest.raises(M.MetricError, match="no samples"):
            rollups.series(table, query)
        return
    found = shown(rollups.series(table, query))
    assert found == shown(M.metric_series(table, query)) and found


@pytest.mark.parametrize("aggregate", ["sum", "count", "min", "max", "per_minute", "p50"])
def test_other_aggregates_groups_and_limits(table, rollups, aggregate):
    more = {} if aggregate in ("sum", "p50") else {"group_by": ("zone", "route"), "group_limit": 2}
    query = request(aggregate, DAY + HOUR, 5 * DAY + 999, 3 * HOUR, **more)
    assert shown(rollups.series(table, query)) == shown(M.metric_series(table, query))


def test_latest_skips_samples_without_value(spark, tmp_path):
    rows = records(spark, [metric("a", DAY * NANO, 1.0, type="gauge"), metric("b", (DAY + 5) * NANO, None, type="gauge")])
    made = MetricRollups(spark, str(tmp_path), by_value=False)
    made.upsert()(rows, 0)
    query = request("latest", DAY, 2 * DAY, DAY)
    assert shown(made.series(rows, query)) == [(DAY, 1.0)] == shown(M.metric_series(rows, query))


def test_covered_records_are_not_read(table, rollups):
    start, end = DAY, 5 * DAY + 3 * HOUR + 600_000
    covered = search.time_range(start, 5 * DAY + 3 * HOUR - 1)
    bad = table.withColumn("value", F.when(covered, F.raise_error(F.lit("read"))).otherwise(F.col("value")).cast("double"))
    for aggregate in ["sum", "p99"]:
        query = request(aggregate, start, end, DAY, group_by=("zone",))
        assert shown(rollups.series(bad, query)) == shown(M.metric_series(table, query))


def test_ranges_that_are_left_hold_what_no_period_answers_for(spark):
    for start, end, step in SPANS:
        query = request("sum", start, end, step)
        times = spark.range(start, min(end + 1, start + 3 * DAY), 61_001).withColumn("tier", tier_of(F.col("id"), query))
        rest, hours = left_over(query, HOUR), left_over(query, DAY)
        for time, tier in times.collect():
            assert tier != 0 or any(a <= time < b for a, b in rest)
            assert tier != HOUR or any(a <= time < b for a, b in hours)
    assert left_over(request("sum", DAY, 9 * DAY - 1, DAY), HOUR) == []
    assert left_over(request("sum", DAY + 5, 999 * DAY, HOUR), HOUR) == [(DAY + 5, 999 * DAY + 1)]


def test_requests_that_rollups_cannot_answer(spark, table, rollups, tmp_path):
    span = (DAY, 3 * DAY, DAY)
    with pytest.raises(M.MetricError, match="predicate"):
        rollups.series(table, request("sum", *span, predicate=search.eq("level", "x")))
    with pytest.raises(M.MetricError, match="not kept by host"):
        rollups.series(table, request("sum", *span, group_by=("host",)))
    with pytest.raises(M.MetricError, match="no rollups"):
        MetricRollups(spark, str(tmp_path)).series(table, request("sum", *span))
    with pytest.raises(M.MetricError, match="counts per value"):
        MetricRollups(spark, str(tmp_path), by_value=False).series(table, request("p50", *span))
