"""Predicates, lookup rules, paging and pushdown."""

import pytest
from pyspark.sql import functions as F

from helpers import records
from signaldeck.operators import listing as L
from signaldeck.operators import lookup as J
from signaldeck.operators import search as Q


@pytest.fixture(scope="module")
def error(spark):
    return records(spark, [{
        "project_id": 1, "id": "e1", "signal": "error", "source": "sentry", "ts_nano": 2_000_000, "received_at_ms": 5,
        "level": "error", "message": "Printer out of paper", "title": "PrintError: tray 2",
        "fields": {"attribute.region": "eu", "user.id": "900", "attribute.n": 7, "attribute.ok": True,
                   "attribute.none": None, "attribute.empty": [], "tag.many": "x", "attribute.many": ["a", "b", 3],
                   "odd*name": 1, "attribute.star": "a*b", "attribute.pct": "50%_x\\y"},
    }]).cache()


CASES = [
    (lambda: Q.any_of(Q.all_of(Q.has("absent"), Q.eq("ok", True)), Q.all_of(Q.ge("n", 7), Q.not_(Q.in_("many", ["z"])))), True),
    (lambda: Q.all_of(Q.any_of(Q.eq("region", "eu"), Q.eq("region", "asia")), Q.text("toner")), False),
    (lambda: Q.not_(Q.eq("level", "error")), False),
    (lambda: Q.text("out of paper"), True),
    (lambda: Q.text("PRINTER out"), True),
    (lambda: Q.text("toner"), False),
    (lambda: Q.eq("user.id", 900), False),
    (lambda: Q.eq("n", 7), True), (lambda: Q.eq("n", "7"), False), (lambda: Q.eq("n", 7.0), True),
    (lambda: Q.gt("n", 6.5), True), (lambda: Q.lt("n", 7), False), (lambda: Q.le("n", 7), True),
    (lambda: Q.gt("region", "ea"), True), (lambda: Q.lt("region", "Z"), False), (lambda: Q.gt("region", 1), False),
    (lambda: Q.eq("ok", True), True), (lambda: Q.eq("ok", 1), False), (lambda: Q.gt("ok", False), False),
    (lambda: Q.eq("many", "b"), True), (lambda: Q.eq("many", 3), True), (lambda: Q.eq("many", "c"), False),
    (lambda: Q.eq("tags[region]", "eu"), True), (lambda: Q.eq("tags[nothing]", "eu"), False),
    (lambda: Q.has("none"), True), (lambda: Q.has("empty"), False), (lambda: Q.has("absent"), False),
    (lambda: Q.has("level"), True), (lambda: Q.has("logger"), False),
    (lambda: Q.not_(Q.eq("logger", "x")), True), (lambda: Q.not_(Q.gt("absent", 1)), True),
    (lambda: Q.glob("message", "Printer*paper"), True), (lambda: Q.glob("message", "printer*"), False),
    (lambda: Q.glob("star", "a*b"), True), (lambda: Q.glob("pct", "50%_x\\*"), True), (lambda: Q.glob("pct", "50x*"), False),
    (lambda: Q.eq("event_id", "e1"), False), (lambda: Q.eq("id", "e1"), True),
    (lambda: Q.eq("project.id", 1), True), (lambda: Q.eq("received_at", 5), True),
    (lambda: Q.eq("event.timestamp", 2_000_000), True), (lambda: Q.eq("source", "sentry"), True),
    (lambda: Q.in_("level", []), False), (lambda: Q.in_("level", ["info", "error", 3]), True),
    (lambda: Q.ge("level", "error"), True), (lambda: Q.gt("level", "error"), False), (lambda: Q.lt("level", "f"), True),
]


def test_predicates(error):
    flags = error.select(*[F.coalesce(make(), F.lit(False)).alias(f"c{i}") for i, (make, _) in enumerate(CASES)]).first()
    kept = [error.filter(make()).count() for make, _ in CASES[:3]]
    assert [bool(f) for f in flags] == [want for _, want in CASES]
    assert kept == [int(want) for _, want in CASES[:3]]


def test_promoted_field_of_another_type(spark):
    """A value that is not of the promoted type stays searchable in ``fields``."""
    df = records(spark, [
        {"project_id": 1, "id": "a", "signal": "log", "fields": {"level": ["warn", "error"]}},
        {"project_id": 1, "id": "b", "signal": "log", "fields": {"level": 5, "attribute.logger": "x"}},
    ])
    found = lambda p: [r.id for r in df.filter(p).collect()]
    assert found(Q.eq("level", "error")) == ["a"] and found(Q.eq("level", 5)) == ["b"]
    assert found(Q.eq("logger", "x")) == ["b"] and found(Q.glob("level", "w*")) == ["a"]


@pytest.mark.parametrize("field", ["user.unknown", "http.body", "project.name", "error.code"])
def test_unknown_reserved_fields(field):
    with pytest.raises(Q.UnsupportedField):
        Q.validate_field(field)


def test_free_fields_are_allowed():
    for field in ("anything", "attribute.x", "tags[a.b]", "resource.service.name", "firstSeen"):
        assert Q.validate_field(field) == field


def test_keyset_paging_inside_one_millisecond(spark):
    df = records(spark, [
        {"project_id": 1, "id": i, "signal": "log", "ts_nano": 5_000_000 + ns}
        for i, ns in (("a", 300), ("z", 200), ("m", 200), ("y", 100))
    ])
    first = Q.search_records(df, 1, "log", limit=2).collect()
    assert sorted(r.id for r in first) == ["a", "z"] and first[0].has_more
    cursor = Q.next_cursor(first)
    second = Q.search_records(df, 1, "log", limit=2, cursor=cursor).collect()
    assert sorted(r.id for r in second) == ["m", "y"] and Q.next_cursor(second) is None


def test_ranges_and_limits(spark):
    assert Q.checked_range(None, 10_000_000) == (6_400_000, 10_000_000)
    assert Q.checked_range(None, None, now_ms=10) == (0, 10)
    with pytest.raises(ValueError):
        Q.checked_range(5, 4)
    df = records(spark, [{"project_id": 1, "id": str(i), "signal": "log", "ts_nano": i * 1_000_000 + 999_999} for i in range(5)])
    assert {r.id for r in df.filter(Q.time_range(1, 3)).collect()} == {"1", "2", "3"}
    for limit in (0, -1):
        with pytest.raises(ValueError):
            Q.page(df, limit)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    records(spark, [{"project_id": 1, "id": "a", "signal": "log", "ts_nano": 1, "level": "info", "raw": "{}"}]).write.parquet(path)
    df = spark.read.parquet(path)
    keep = Q.all_of(Q.eq("level", "info"), Q.gt("value", 3), Q.glob("name", "ab*"), Q.in_("unit", ["ms", "s"]))
    rows = Q.matching(df, 1, "log", keep, 0, 10).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    for part in ("EqualTo(project_id,1)", "EqualNullSafe(level,info)", "GreaterThanOrEqual(value,3.0)",
                 "GreaterThanOrEqual(name,ab)", "unit", "ts_nano"):
        assert part in pushed, (part, pushed)
    assert "raw" not in plan[plan.index("ReadSchema"):]


def test_issue_resolution(spark):
    errors = records(spark, [
        {"project_id": 1, "id": f"r{i}", "signal": "error", "issue_id": "i", "ts_nano": i, "received_at_ms": i} for i in range(3)
    ])
    issues = spark.createDataFrame(
        [(1, "i", "t", "error", 0, 0, 3, 3, "gone"), (1, "j", "t", "error", 0, 0, 1, 0, None)],
        "project_id bigint, issue_id string, title string, level string, first_seen_ms bigint, last_seen_ms bigint, "
        "total_seen bigint, retained_events bigint, latest_record_id string")
    latest = {r.issue_id: r.record_id for r in J.issue_latest(issues, errors).collect()}
    assert latest == {"i": "r2", "j": None}
    assert J.record_or_issue(errors, issues, 1, "r1").first().kind == "record"
    found = J.record_or_issue(errors, issues, 1, "i").first()
    assert (found.kind, found.record_id) == ("issue", "r2")
    assert J.record_or_issue(errors, issues, 1, "nothing").count() == 0


def test_views_and_truncation(spark):
    df = records(spark, [{"project_id": 1, "id": "a", "signal": "log", "source": "otlp", "ts_nano": 7, "received_at_ms": 3,
                          "level": "info", "raw": "é" * 40, "fields": {"id": "shadowed", "attribute.x": [1]}}])
    row = L.record_view(df, raw=True).withColumn("f", F.to_json("fields")).first()
    assert row.f == ('{"attribute.x":[1],"id":"a","level":"info","project.id":1,"received":3,"signal":"log",'
                     '"source":"otlp","timestamp":7}')
    cut = L.truncate_raw(df, 33).first()
    assert cut.raw == "é" * 16 and cut.raw_truncated
    assert not L.truncate_raw(df, 80).first().raw_truncated


def test_collapse_frames(spark):
    flags = [False, False, True, True, False, False, False, True]
    df = spark.createDataFrame([(1, [(i, f) for i, f in enumerate(flags)]), (2, [])],
                               "n int, frames array<struct<i: int, in_app: boolean>>")
    groups = {r.n: [(g.in_app, [f.i for f in g.frames]) for g in r.frame_groups] for r in L.collapse_frames(df, "frames").collect()}
    assert groups == {1: [(False, [0, 1]), (True, [2]), (True, [3]), (False, [4, 5, 6]), (True, [7])], 2: []}


def test_issue_paging(spark):
    issues = spark.createDataFrame(
        [(1, f"i{n}", "Boom", "error", 1, n // 2, n, n, None) for n in range(5)],
        "project_id bigint, issue_id string, title string, level string, first_seen_ms bigint, last_seen_ms bigint, "
        "total_seen bigint, retained_events bigint, latest_record_id string")
    seen, cursor = [], None
    while True:
        rows = Q.search_issues(issues, 1, Q.all_of(Q.text("boom"), Q.has("timesSeen")), limit=2, cursor=cursor).collect()
        seen += sorted((r.issue_id for r in rows), reverse=True)
        cursor = Q.next_issue_cursor(rows)
        if cursor is None:
            break
    assert seen == ["i4", "i3", "i2", "i1", "i0"]
    assert Q.search_issues(issues, 1, Q.ge("timesSeen", 3)).count() == 2
    assert Q.search_issues(issues, 1, Q.eq("issue", "i2")).first().title == "Boom"


@pytest.mark.parametrize("name", ['a"b', "a'b", """a'"b""", "a.b", "a]b"])
def test_field_names_with_marks(spark, name):
    df = records(spark, [{"id": "x", "fields": {name: 1}}, {"id": "y", "fields": {}}])
    assert [r.id for r in df.filter(Q.eq(name, 1)).collect()] == ["x"]
