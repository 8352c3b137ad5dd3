"""Envelope queries over customers, parts and events: canonical fields, stacks, and every cause of a reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.operators import envelopes as E
from signaldeck.operators import metrics as M
from signaldeck.plans import metric_queries as m
from signaldeck.plans import views as v
from signaldeck.plans.registry import query
from signaldeck.sources.envelopes import frame_envelopes


def framed(rows: DataFrame, *lines: Column) -> DataFrame:
    """One envelope of the given lines per row, under the row's ``n``."""
    return frame_envelopes(rows.select(
        F.col("n").cast("string").alias("envelope_id"), F.lit(1).cast("bigint").alias("project_id"),
        F.lit(9).cast("bigint").alias("received_at_ms"), F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("body"),
    ))


def obj(**members: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in members.items()])


def some(condition: Column, value: Column | str) -> Column:
    return F.when(condition, value)


def held(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("fields", f"$[{path}]", kind)


EVENT_HEAD = '{"type":"event"}'


@query("canonical_fields", sql="""SELECT md5(CAST(c_custkey AS VARCHAR)) AS id,
  CASE WHEN c_custkey % 2 = 0 THEN md5('c' || c_custkey) ELSE md5('e' || c_custkey) END AS trace_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_custkey % 7 ELSE 'er' END AS release, 'prod' AS environment, c_name AS server,
  't' || c_nationkey AS name, CAST(c_custkey AS VARCHAR) AS user_id, c_name || '@x' AS email, c_mktsegment AS tier,
  'GET' AS method, c_mktsegment AS tag, c_mktsegment AS attribute, 'db' AS op, 'linux' AS os,
  CASE WHEN c_custkey % 4 = 0 THEN 'py' ELSE 'env' END AS sdk, '1' AS sdk_version,
  CASE c_custkey % 5 WHEN 0 THEN 'm' || c_custkey WHEN 1 THEN 'f' || c_custkey WHEN 2 THEN 'lf' WHEN 3 THEN 'lm' END AS message
  FROM customer""")
def _(spark, d):
    """Where a field may come from several places, the first that holds it wins."""
    rows = v.spread(v.table(spark, d, "customer")).withColumn("n", F.col("c_custkey"))
    n = F.col("n")
    text, segment = n.cast("string"), F.col("c_mktsegment")
    head = obj(
        event_id=F.md5(text), sdk=obj(name=F.lit("env"), version=F.lit("1")),
        trace=obj(trace_id=F.md5(F.concat(F.lit("e"), text)), release=F.lit("er"), environment=F.lit("prod")),
    )
    quoted = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    pairs = F.concat(F.lit('[["seg",'), quoted(segment), F.lit('],["alone"],"odd"]'))
    tags = F.when(n % 2 == 0, F.to_json(obj(seg=segment))).otherwise(pairs)
    message = some(n % 5 == 0, quoted(F.concat(F.lit("m"), text))).when(n % 5 == 1, F.to_json(obj(formatted=F.concat(F.lit("f"), text))))
    event = F.to_json(obj(
        timestamp=n, transaction=F.concat(F.lit("t"), F.col("c_nationkey").cast("string")), server_name=F.col("c_name"),
        release=some(n % 3 == 0, F.concat(F.lit("r"), (n % 7).cast("string"))),
        user=obj(id=text, email=F.concat("c_name", F.lit("@x")), tier=segment), request=obj(method=F.lit("GET")),
        contexts=obj(trace=obj(trace_id=some(n % 2 == 0, F.md5(F.concat(F.lit("c"), text))), op=F.lit("db")), os=obj(name=F.lit("linux"))),
        sdk=some(n % 4 == 0, obj(name=F.lit("py"))),
        logentry=some(n % 5 == 2, obj(formatted=F.lit("lf"), message=F.lit("no"))).when(n % 5 == 3, obj(formatted=F.lit(None).cast("string"), message=F.lit("lm"))),
    ))
    event = F.concat(F.lit('{"tags":'), tags, F.coalesce(F.concat(F.lit(',"message":'), message), F.lit("")), F.lit(","), F.substring(event, 2, 1 << 30))
    errors = E.events_to_errors(framed(rows, F.to_json(head), F.lit(EVENT_HEAD), event))
    return errors.select(
        "id", "trace_id", "release", "environment", "server", "name", held('"user.id"').alias("user_id"), held('"user.email"').alias("email"),
        held('"user.tier"').alias("tier"), held('"http.method"').alias("method"), held('"tag.seg"').alias("tag"),
        held('"attribute.seg"').alias("attribute"), held('"trace.op"').alias("op"), F.try_variant_get("fields", '$["context.os"].name', "string").alias("os"),
        held('"sdk.name"').alias("sdk"), held('"sdk.version"').alias("sdk_version"), "message",
    )


def part_errors(spark, d) -> DataFrame:
    """parts as events: two exceptions, or for every third only a stack of its own."""
    rows = v.spread(v.table(spark, d, "part")).withColumn("n", F.col("p_partkey"))
    n = F.col("n")

    def stack(tag: str) -> Column:
        frame = lambda i: obj(
            filename=F.concat(F.lit(f"{tag}{i}."), (n % 11).cast("string")), function=F.col("p_brand"),
            lineno=(n + i).cast("bigint"), in_app=F.lit(i == 1),
        )
        return obj(frames=F.array(frame(0), frame(1)))

    one = lambda tag, kind: obj(
        type=F.lit(kind), value=F.col("p_type"), stacktrace=stack(tag), mechanism=obj(type=F.lit("hook"), handled=n % 2 == 0),
    )
    chain = some(n % 3 != 0, obj(values=F.array(one("a", "Cause"), one("b", "Outer"))))
    event = F.to_json(obj(timestamp=n, exception=chain, stacktrace=some(n % 3 == 0, stack("s"))))
    head = F.to_json(obj(event_id=F.md5(n.cast("string"))))
    return E.events_to_errors(framed(rows, head, F.lit(EVENT_HEAD), event))


PART_ID = "md5(CAST(p_partkey AS VARCHAR)) AS id, p_partkey % 3 <> 0 AS c, CAST(p_partkey % 11 AS VARCHAR) AS f"


@query("normalized_exceptions", sql=f"""SELECT id, CASE WHEN c THEN 'Outer' ELSE 'Stacktrace' END AS first, CASE WHEN c THEN 'Cause' END AS second,
  CASE WHEN c THEN p_type END AS message, CASE WHEN c THEN p_partkey % 2 = 0 END AS handled, CASE WHEN c THEN 'hook' END AS mechanism,
  CASE WHEN c THEN 'b1.' ELSE 's1.' END || f AS filename, p_partkey + 1 AS line, true AS in_app FROM (SELECT *, {PART_ID} FROM part)""")
def _(spark, d):
    at = lambda path, kind="string": F.try_variant_get("fields", f'$["error.exceptions"]{path}', kind)
    return part_errors(spark, d).select(
        "id", at("[0].type").alias("first"), at("[1].type").alias("second"), at("[0].message").alias("message"),
        at("[0].handled", "boolean").alias("handled"), at("[0].mechanism").alias("mechanism"), at("[0].frames[1].filename").alias("filename"),
        at("[0].frames[1].line", "bigint").alias("line"), at("[0].frames[1].in_app", "boolean").alias("in_app"),
    )


@query("stack_fields", sql=f"""SELECT id, CASE WHEN c THEN 'a0.' || f || ' a1.' || f || ' b0.' || f || ' b1.' || f ELSE 's0.' || f || ' s1.' || f END AS filenames,
  CASE WHEN c THEN p_brand || ' ' || p_brand || ' ' ELSE '' END || p_brand || ' ' || p_brand AS functions, true AS no_module
  FROM (SELECT *, {PART_ID} FROM part)""")
def _(spark, d):
    return part_errors(spark, d).select(
        "id", F.concat_ws(" ", held('"stack.filename"', "array<string>")).alias("filenames"),
        F.concat_ws(" ", held('"stack.function"', "array<string>")).alias("functions"),
        held('"stack.module"', "variant").isNull().alias("no_module"),
    )


@query("validate_telemetry", sql="""SELECT event_id AS n, event_id % 2 AS metric, event_id % 18 IN (0, 1, 16, 17) AS valid FROM events""")
def _(spark, d):
    """Batch items of one log or metric with a defect of each kind; the last entry of a cycle has a time as text."""
    rows = v.spread(v.table(spark, d, "events")).withColumn("n", F.col("event_id"))
    n = F.col("n")
    log, cause = n % 2 == 0, F.floor(F.pmod(n, F.lit(18)) / 2)
    time = some(cause == 1, F.lit('"soon"')).when(cause == 8, F.lit('"2024-01-05T00:00:00Z"')).otherwise((n * 1.5).cast("string"))
    trace = some(cause != 2, F.lit("c" * 32))
    logs = F.to_json(obj(trace_id=trace, level=some(cause == 3, "odd").when(cause != 4, "warn"), body=some(cause != 5, F.col("event_type"))))
    metrics = F.to_json(obj(
        trace_id=trace, name=some(cause != 3, F.col("event_type")), type=some(cause == 4, "timer").otherwise("gauge"), value=some(cause != 5, F.col("value")),
    ))
    entry = F.concat(F.lit('{"timestamp":'), time, F.lit(","), F.substring(F.when(log, logs).otherwise(metrics), 2, 1 << 30))
    entry = F.when(cause == 6, F.lit("7")).otherwise(entry)
    head = F.to_json(obj(type=F.when(log, "log").otherwise("trace_metric"), item_count=F.when(cause == 7, 2).otherwise(1)))
    envelopes = framed(rows, F.lit("{}"), head, F.concat(F.lit('{"items":['), entry, F.lit("]}")))
    number = F.col("envelope_id").cast("bigint")
    return E.validate_envelopes(envelopes).select(number.alias("n"), (number % 2).alias("metric"), "valid")


@query("validate_event", sql="""SELECT c_custkey AS n, c_custkey % 10 IN (0, 1, 2, 3) AS valid FROM customer""")
def _(spark, d):
    """Events with ids in several spellings, and with each cause of a reject."""
    rows = v.spread(v.table(spark, d, "customer")).withColumn("n", F.col("c_custkey"))
    n = F.col("n")
    cause, own = n % 10, F.md5(n.cast("string"))
    dashed = F.upper(F.regexp_replace(own, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    inner = some(cause == 1, dashed).when(cause == 2, F.concat(F.lit("urn:uuid:"), dashed)).when(cause == 4, F.md5(own)).when(cause == 5, "no id")
    event = F.to_json(obj(event_id=inner, timestamp=F.when(cause == 6, "yesterday").otherwise("2024-01-05T00:00:00.5+01:00"), message=F.col("c_name")))
    event = F.when(cause == 7, F.concat(F.lit("["), event, F.lit("]"))).when(cause == 8, F.substring(event, 2, 1 << 30)).otherwise(event)
    head = F.when(cause == 9, "no object").when(cause == 3, "{}").otherwise(F.to_json(obj(event_id=own)))
    # Without an id outside, the one inside counts.
    event = F.when(cause == 3, F.concat(F.lit('{"event_id":"'), own, F.lit('"}'))).otherwise(event)
    return E.validate_envelopes(framed(rows, head, F.lit(EVENT_HEAD), event)).select(F.col("envelope_id").cast("bigint").alias("n"), "valid")


RULES = [("sum", "increase"), ("sum", "latest"), ("gauge", "latest"), ("gauge", "p95"), ("distribution", "p95"), ("distribution", "increase"), ("histogram", "count")]


@query("metric_type_rule", v.EM, sql=f"""SELECT type, aggregate, (SELECT count(DISTINCT {m.BUCKET}) FROM em WHERE {m.RANGE}) AS points
  FROM (VALUES ('sum', 'increase'), ('gauge', 'latest'), ('distribution', 'p95')) AS t(type, aggregate)""")
def _(spark, d):
    """Series of each type; aggregates that a type does not have are refused."""
    found = None
    for metric_type, aggregate in RULES:
        try:
            series = M.metric_series(v.ev_metrics(spark, d, metric_type), m.request(aggregate))
        except M.MetricError:
            continue
        points = series.agg(F.count(F.lit(1)).alias("points")).select(F.lit(metric_type).alias("type"), F.lit(aggregate).alias("aggregate"), "points")
        found = points if found is None else found.unionByName(points)
    return found
