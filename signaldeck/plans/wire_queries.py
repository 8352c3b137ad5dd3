"""Flattening and validation queries: driver tables written as export batches.

Every table row becomes one small export request in JSON, which is then read with the
declared schema exactly as a file of requests would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.functions.stage import staged
from signaldeck.operators import ddtrace as D
from signaldeck.operators import envelopes as E
from signaldeck.operators import otel as O
from signaldeck.plans import views as v
from signaldeck.plans.registry import query
from signaldeck.plans.search_queries import duration_sql
from signaldeck.session import LineageCut
from signaldeck.sources import ddtrace as dd
from signaldeck.sources.envelopes import frame_envelopes, read_envelopes, stream_envelopes
from signaldeck.sources.otel import otel_ddl
from signaldeck.streaming.jobs import run_available


MEMBERS = {"string_value": "string", "bool_value": "boolean", "int_value": "bigint", "double_value": "double"}


def kv(key: str, **value: Column) -> Column:
    (kind, column), = value.items()
    members = [(column if name == kind else F.lit(None)).cast(type_).alias(name) for name, type_ in MEMBERS.items()]
    return F.struct(F.lit(key).alias("key"), F.struct(*members).alias("value"))


def attributes(*entries: Column) -> Column:
    """JSON text of an attribute list; JSON leaves out the value members that are not set."""
    return F.to_json(F.array(*entries))


def document(**parts: Column | str) -> Column:
    """JSON object text; parts ending in ``_json`` are JSON already."""
    pieces = [F.concat(F.lit(f'"{name[:-5]}":'), part) for name, part in parts.items() if name.endswith("_json")]
    plain = [part.alias(name) for name, part in parts.items() if not name.endswith("_json")]
    if plain:
        # The members are written at once.
        members = F.to_json(F.struct(*plain))
        pieces.append(F.substring(members, F.lit(2), F.length(members) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.nullif(p, F.lit("")) for p in pieces]), F.lit("}"))


def request(kind: str, service: Column, item: Column) -> tuple[str, Column]:
    """Kind and text of an export request of one item."""
    top, scoped, leaf = {
        "traces": ("resource_spans", "scope_spans", "spans"),
        "logs": ("resource_logs", "scope_logs", "log_records"),
        "metrics": ("resource_metrics", "scope_metrics", "metrics"),
    }[kind]
    resource = document(attributes_json=attributes(kv("service.name", string_value=service)))
    return kind, F.concat(
        F.lit(f'{{"{top}":[{{"resource":'), resource,
        F.lit(f',"schema_url":"s1","{scoped}":[{{"scope":{{"name":"lib","version":""}},"{leaf}":['),
        item, F.lit("]}]}]}"),
    )


def requests(table: DataFrame, received_at_ms: int, written: tuple[str, Column]) -> DataFrame:
    """Project 1's requests, each written and parsed once."""
    kind, text = written
    rows = v.spread(table).select(
        F.lit(1).cast("bigint").alias("project_id"),
        F.lit(received_at_ms).cast("bigint").alias("received_at_ms"), text.alias("_text"),
    )
    return staged(rows, r=F.from_json("_text", otel_ddl(kind))).select("project_id", "received_at_ms", "r.*")


def b64(hex_text: Column) -> Column:
    return F.base64(F.unhex(hex_text))


def id_hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def li_otel(spark, d) -> DataFrame:
    """lineitem as one-span requests, some of them invalid."""
    li = v.table(spark, d, "lineitem")
    c = F.col
    start = v.epoch_micros(c("l_shipdate")) * 1000
    end = start + F.when(c("l_tax") == 0.08, F.lit(-1)).otherwise(c("l_quantity").cast("bigint") * 1_000_000)
    span_id = F.when(c("l_suppkey") % 10 == 0, F.lit(0)).otherwise(c("l_partkey") * 8 + c("l_linenumber"))
    escaped = c("l_linenumber") % 2 == 0
    # JSON leaves out what is null.
    event = F.struct(
        F.when(c("l_linenumber") == 1, F.lit(0)).otherwise(start + 5).alias("time_unix_nano"),
        F.lit("exception").alias("name"),
        F.array(
            kv("exception.type", string_value=F.concat(F.lit("Err"), c("l_returnflag"))),
            kv("exception.message", string_value=F.when(c("l_linenumber") > 3, "failed").otherwise("")),
            kv("exception.escaped", bool_value=escaped),
        ).alias("attributes"),
    )
    members = dict(
        trace_id=b64(id_hex(c("l_orderkey") + 1, 32)),
        span_id=b64(id_hex(span_id, 16)),
        parent_span_id=F.when(c("l_linenumber") > 1, b64(id_hex(c("l_partkey") * 8 + 1, 16))),
        name=F.when(c("l_linenumber") == 7, "").otherwise(F.concat("l_returnflag", "l_linestatus")),
        kind=c("l_linenumber"),
        start_time_unix_nano=start,
        end_time_unix_nano=end,
        attributes=F.array(kv("part", int_value=c("l_partkey")), kv("price", double_value=c("l_extendedprice"))),
        status=F.struct((c("l_suppkey") % 3).cast("int").alias("code")),
        events=F.when(c("l_linestatus") == "F", F.array(event)).otherwise(F.array()),
    )
    span = F.to_json(F.struct(*[member.alias(name) for name, member in members.items()]))
    return requests(li, 9, request("traces", c("l_returnflag"), span))


LI = """li AS (SELECT *, lpad(lower(to_hex(l_orderkey + 1)), 32, '0') AS trace_id,
    lpad(lower(to_hex(l_partkey * 8 + l_linenumber)), 16, '0') AS span_id,
    epoch_us(l_shipdate) * 1000 AS start_ns, l_suppkey % 10 <> 0 AND l_linenumber <> 7 AND l_tax <> 0.08 AS ok
  FROM lineitem)"""
KIND_SQL = """CASE l_linenumber WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer'
  WHEN 5 THEN 'consumer' ELSE 'unspecified' END"""
STATUS_SQL = "CASE l_suppkey % 3 WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END"


@query("flatten_spans", LI, sql=f"""SELECT trace_id || '-' || span_id AS id, trace_id, span_id,
  CASE WHEN l_linenumber > 1 THEN lpad(lower(to_hex(l_partkey * 8 + 1)), 16, '0') END AS parent_span_id,
  l_returnflag || l_linestatus AS name, {KIND_SQL} AS span_kind, {STATUS_SQL} AS span_status,
  CAST(l_quantity AS BIGINT) * 1000000 AS duration_ns, start_ns AS ts_nano, l_returnflag AS service_name,
  l_partkey AS part, l_extendedprice AS price FROM li WHERE ok""")
def _(spark, d):
    rows = O.flatten_spans(li_otel(spark, d))
    return rows.select(
        "id", "trace_id", "span_id", "parent_span_id", "name", "span_kind", "span_status", "duration_ns",
        "ts_nano", "service_name",
        F.try_variant_get("fields", '$["attribute.part"]', "bigint").alias("part"),
        F.try_variant_get("fields", '$["attribute.price"]', "double").alias("price"),
    )


@query("span_exceptions", LI, sql="""SELECT trace_id || '-' || span_id || '-exception-' ||
    CASE WHEN l_linenumber = 1 THEN '0' ELSE CAST(start_ns + 5 AS VARCHAR) END || '-0' AS id,
  trace_id || '-' || span_id AS source_record_id, 'Err' || l_returnflag AS error_type,
  'Err' || l_returnflag || CASE WHEN l_linenumber > 3 THEN ': failed' ELSE '' END AS title,
  l_linenumber % 2 <> 0 AS error_handled, 'otlp:Err' || l_returnflag AS fingerprint,
  CASE WHEN l_linenumber = 1 THEN start_ns ELSE start_ns + 5 END AS ts_nano, l_partkey AS part
  FROM li WHERE ok AND l_linestatus = 'F'""")
def _(spark, d):
    rows = O.span_exceptions(li_otel(spark, d))
    return rows.select(
        "id", "source_record_id", "error_type", "title", "error_handled",
        F.col("issue_fingerprint").alias("fingerprint"), "ts_nano",
        F.try_variant_get("fields", '$["attribute.part"]', "bigint").alias("part"),
    )


@query("validate_spans", LI, sql="SELECT ok AS valid, count(*) AS n FROM li GROUP BY ok")
def _(spark, d):
    return O.spans_of(li_otel(spark, d)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def doc_otel(spark, d) -> DataFrame:
    """documents as one-log requests, some of them invalid."""
    n = F.col("doc_id")
    log = document(
        time_unix_nano=F.when(n % 3 == 0, F.lit(0)).otherwise(n * 1_000_000_000 + 1),
        observed_time_unix_nano=F.when(n % 9 == 0, F.lit(0)).otherwise(n * 1_000_000_000 + 2),
        severity_number=(n % 26).cast("int"),
        severity_text=F.when(n % 26 == 0, F.element_at(F.array(*map(F.lit, ("WARNING", "Fatal", "odd"))), (F.expr("doc_id div 26") % 3 + 1).cast("int"))).otherwise(""),
        body=F.struct(F.col("text").alias("string_value")),
        attributes_json=attributes(kv("lang", string_value=F.col("lang"))),
        trace_id=F.when(n % 4 == 0, b64(id_hex(n + 1, 32))),
        span_id=F.when(n % 8 < 2, b64(id_hex(n + 1, 16))),
        event_name=F.when(n % 7 == 0, "exception").otherwise(""),
    )
    return requests(v.table(spark, d, "documents"), 77, request("logs", F.col("source"), log))


DOC = """doc AS (SELECT *, doc_id % 26 <> 25 AND doc_id % 8 <> 1 AS ok,
    CASE WHEN doc_id % 3 <> 0 THEN doc_id * 1000000000 + 1 WHEN doc_id % 9 <> 0 THEN doc_id * 1000000000 + 2
      ELSE 77000000 END AS ts_nano,
    CASE WHEN doc_id % 26 = 0 THEN CASE (doc_id // 26) % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'fatal' ELSE 'info' END
      WHEN doc_id % 26 <= 4 THEN 'trace' WHEN doc_id % 26 <= 8 THEN 'debug' WHEN doc_id % 26 <= 12 THEN 'info'
      WHEN doc_id % 26 <= 16 THEN 'warn' WHEN doc_id % 26 <= 20 THEN 'error' ELSE 'fatal' END AS level
  FROM documents)"""


@query("flatten_logs", DOC, sql="""SELECT md5(text) AS message_md5, level, ts_nano, source AS service_name, lang,
  CASE WHEN doc_id % 4 = 0 THEN lpad(lower(to_hex(doc_id + 1)), 32, '0') END AS trace_id,
  CASE WHEN doc_id % 8 < 2 THEN lpad(lower(to_hex(doc_id + 1)), 16, '0') END AS span_id FROM doc WHERE ok""")
def _(spark, d):
    return shown_logs(O.flatten_logs(doc_otel(spark, d)))


def shown_logs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.md5("message").alias("message_md5"), "level", "ts_nano", "service_name",
        F.try_variant_get("fields", '$["attribute.lang"]', "string").alias("lang"), "trace_id", "span_id",
    )


@query("log_exceptions", DOC, sql="""SELECT 'Exception' AS title, source AS service_name, ts_nano, lang, true AS linked
  FROM doc WHERE ok AND doc_id % 7 = 0""")
def _(spark, d):
    rows = O.log_exceptions(doc_otel(spark, d))
    linked = F.col("id") == F.concat("source_record_id", F.lit("-exception"))
    return rows.select(
        "title", "service_name", "ts_nano", F.try_variant_get("fields", '$["attribute.lang"]', "string").alias("lang"),
        linked.alias("linked"),
    )


@query("validate_logs", DOC, sql="SELECT ok AS valid, count(*) AS n FROM doc GROUP BY ok")
def _(spark, d):
    return O.logs_of(doc_otel(spark, d)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def ev_otel(spark, d) -> DataFrame:
    """events as one-point requests: each event type is another kind of metric."""
    n, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    time = F.when(n % 11 == 0, F.lit(0)).otherwise(v.epoch_micros(F.col("ts")) * 1000)
    start = time - 1000 * (n % 5) + F.when(n % 13 == 0, 10_000).otherwise(0)
    count = F.when(n % 17 == 0, n % 7 + 1).otherwise(n % 7)
    common = {
        "start_time_unix_nano": start, "time_unix_nano": time,
        "attributes_json": attributes(kv("user", int_value=F.col("user_id"))),
    }
    temporality = (n % 3).cast("int")
    arrays = lambda *items: F.array(*[i.cast("bigint") for i in items])
    data = (
        F.when(kind == "click", F.concat(F.lit('"gauge":{"data_points":['), document(**common, as_double=value), F.lit("]}")))
        .when(kind == "view", F.concat(
            F.lit('"sum":{"is_monotonic":true,"aggregation_temporality":'), temporality.cast("string"), F.lit(',"data_points":['),
            document(**common, as_int=n), F.lit("]}")))
        .when(kind == "signup", F.concat(
            F.lit('"histogram":{"aggregation_temporality":'), temporality.cast("string"), F.lit(',"data_points":['),
            document(**common, count=count, bucket_counts=arrays(n % 7, F.lit(0), F.lit(0)),
                     explicit_bounds=F.array(F.lit(1.0), 1.0 + (n % 2))), F.lit("]}")))
        .when(kind == "error", F.concat(
            F.lit('"exponential_histogram":{"aggregation_temporality":'), temporality.cast("string"), F.lit(',"data_points":['),
            document(**common, count=count, zero_count=F.lit(0), scale=F.lit(1),
                     positive=F.struct(arrays(n % 7).alias("bucket_counts"))), F.lit("]}")))
        .otherwise(F.concat(
            F.lit('"summary":{"data_points":['),
            document(**common, count=count, quantile_values=F.array(
                F.struct(F.lit(0.5).alias("quantile"), value.alias("value")),
                F.struct((F.lit(0.5) + (n % 4) / 5).alias("quantile"), value.alias("value")))), F.lit("]}")))
    )
    metric = F.concat(F.lit('{"name":"m.'), kind, F.lit('","unit":"'), F.when(n % 2 == 0, "ms").otherwise(""), F.lit('",'), data, F.lit("}"))
    return requests(v.table(spark, d, "events"), 9, request("metrics", F.lit("svc"), metric))


EO = """eo AS (SELECT *, CASE event_type WHEN 'click' THEN 'gauge' WHEN 'view' THEN 'sum' WHEN 'signup' THEN 'histogram'
      WHEN 'error' THEN 'exponential_histogram' ELSE 'summary' END AS type, epoch_us(ts) * 1000 AS ts_nano,
    epoch_us(ts) * 1000 - 1000 * (event_id % 5) AS start_nano FROM events),
  ep AS (SELECT *, event_id % 11 <> 0 AND event_id % 13 <> 0 AND CASE type WHEN 'gauge' THEN true
      WHEN 'sum' THEN event_id % 3 <> 0
      WHEN 'histogram' THEN event_id % 3 <> 0 AND event_id % 17 <> 0 AND event_id % 2 = 1
      WHEN 'exponential_histogram' THEN event_id % 3 <> 0 AND event_id % 17 <> 0
      ELSE event_id % 4 IN (1, 2) END AS ok FROM eo)"""


@query("flatten_metrics", EO, sql="""SELECT 'm.' || event_type AS name, type, CASE WHEN event_id % 2 = 0 THEN 'ms' END AS unit,
  CASE WHEN type IN ('sum', 'histogram', 'exponential_histogram')
    THEN CASE event_id % 3 WHEN 1 THEN 'delta' ELSE 'cumulative' END END AS temporality,
  CASE WHEN type = 'sum' THEN true END AS monotonic,
  CASE type WHEN 'gauge' THEN value WHEN 'sum' THEN CAST(event_id AS DOUBLE) END AS value,
  ts_nano, start_nano, user_id AS "user", 'svc' AS service_name FROM ep WHERE ok""")
def _(spark, d):
    rows = O.flatten_metrics(ev_otel(spark, d))
    return rows.select(
        "name", "type", "unit", "temporality", "monotonic", "value", "ts_nano", "start_nano",
        F.try_variant_get("fields", '$["attribute.user"]', "bigint").alias("user"), "service_name",
    )


@query("metric_streams", EO, sql="""SELECT type, count(DISTINCT struct_pack(user_id, u := event_id % 2, t := CASE WHEN type IN
    ('sum', 'histogram', 'exponential_histogram') THEN event_id % 3 END)) AS streams FROM ep WHERE ok GROUP BY type""")
def _(spark, d):
    rows = O.flatten_metrics(ev_otel(spark, d))
    return rows.groupBy("type").agg(F.count_distinct("stream_id").alias("streams"))


@query("validate_points", EO, sql="SELECT type, ok AS valid, count(*) AS n FROM ep WHERE type IN ('gauge', 'sum') GROUP BY type, ok")
def _(spark, d):
    rows = O.points_of(ev_otel(spark, d)).select(F.col("point.type").alias("type"), "valid")
    return rows.filter(F.col("type").isin("gauge", "sum")).groupBy("type", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("validate_histogram", EO, sql="SELECT type, ok AS valid, count(*) AS n FROM ep WHERE type NOT IN ('gauge', 'sum') GROUP BY type, ok")
def _(spark, d):
    rows = O.points_of(ev_otel(spark, d)).select(F.col("point.type").alias("type"), "valid")
    return rows.filter(~F.col("type").isin("gauge", "sum")).groupBy("type", "valid").agg(F.count(F.lit(1)).alias("n"))


def dd_payloads(spark, d) -> DataFrame:
    """lineitem as one-span payloads, some of them invalid."""
    c = F.col
    span = F.struct(
        c("l_returnflag").alias("service"),
        F.when(c("l_linenumber") == 7, "").otherwise("web.request").alias("name"),
        F.when(c("l_linenumber") == 6, "").otherwise(F.concat(F.lit("GET /"), c("l_partkey").cast("string"))).alias("resource"),
        (c("l_orderkey") - 3).alias("trace_id"),
        (c("l_partkey") * 8 + c("l_linenumber")).alias("span_id"),
        F.when(c("l_linenumber") == 1, 0).otherwise(c("l_partkey")).alias("parent_id"),
        (v.epoch_micros(c("l_shipdate")) * 1000).alias("start"),
        F.when(c("l_tax") == 0.08, -1).otherwise(c("l_quantity").cast("bigint") * 1_000_000).alias("duration"),
        F.when(c("l_linestatus") == "F", 1).otherwise(0).alias("error"),
        F.create_map(
            F.lit("env"), F.lit("prod"), F.lit("error.type"), F.concat(F.lit("E"), c("l_returnflag")),
            F.lit("_dd.p.tid"), F.when(c("l_linenumber") == 2, "xyz").otherwise("0123456789ABCDEF"), F.lit("same"), F.lit("text"),
        ).alias("meta"),
        F.create_map(
            F.lit("same"), c("l_discount"), F.lit("bad"), F.lit(float("nan")),
        ).alias("metrics"),
        F.lit("web").alias("type"),
    ).cast(dd.SPAN)
    return v.spread(v.table(spark, d, "lineitem")).select(
        F.lit(1).cast("bigint").alias("project_id"), F.lit(9).cast("bigint").alias("received_at_ms"),
        F.array(F.array(span)).alias("traces"),
    )


DDS = """dds AS (SELECT *, CASE WHEN l_linenumber = 2 THEN '' ELSE '0123456789abcdef' END ||
      CASE WHEN l_orderkey < 3 THEN 'fffffffffffffff' || lower(to_hex(13 + l_orderkey)) ELSE lpad(lower(to_hex(l_orderkey - 3)), 16, '0') END AS trace_id,
    lpad(lower(to_hex(l_partkey * 8 + l_linenumber)), 16, '0') AS span_id,
    CASE WHEN l_linenumber = 6 THEN '' ELSE 'GET /' || CAST(l_partkey AS VARCHAR) END AS resource,
    l_orderkey <> 3 AND l_linenumber <> 7 AND l_tax <> 0.08 AS ok FROM lineitem)"""


@query("flatten_ddtrace", DDS, sql="""SELECT trace_id || '-' || span_id AS id, trace_id, span_id,
  CASE WHEN l_linenumber <> 1 AND l_partkey <> 0 THEN lpad(lower(to_hex(l_partkey)), 16, '0') END AS parent_span_id,
  CASE WHEN resource = '' THEN 'web.request' ELSE resource END AS message, l_returnflag AS service_name,
  CASE WHEN l_linestatus = 'F' THEN 'error' ELSE 'unset' END AS span_status, 'prod' AS environment,
  CAST(l_quantity AS BIGINT) * 1000000 AS duration_ns, l_discount AS same, CAST(NULL AS DOUBLE) AS bad, 'web' AS kind
  FROM dds WHERE ok""")
def _(spark, d):
    return shown_spans(D.flatten_ddtrace(dd_payloads(spark, d)))


def shown_spans(rows: DataFrame) -> DataFrame:
    get = lambda key, kind: F.try_variant_get("fields", f'$["attribute.{key}"]', kind)
    return rows.select(
        "id", "trace_id", "span_id", "parent_span_id", "message", "service_name", "span_status", "environment",
        "duration_ns", get("same", "double").alias("same"), get("bad", "double").alias("bad"),
        get("datadog.type", "string").alias("kind"),
    )


@query("ddtrace_errors", DDS, sql="""SELECT trace_id || '-' || span_id || '-error' AS id, trace_id || '-' || span_id AS source_record_id,
  'E' || l_returnflag AS error_type, 'E' || l_returnflag || CASE WHEN resource = '' THEN '' ELSE ': ' || resource END AS title,
  'ddtrace:E' || l_returnflag AS fingerprint FROM dds WHERE ok AND l_linestatus = 'F'""")
def _(spark, d):
    return D.ddtrace_errors(dd_payloads(spark, d)).select(
        "id", "source_record_id", "error_type", "title", F.col("issue_fingerprint").alias("fingerprint")
    )


@query("validate_ddtrace", DDS, sql="SELECT ok AS valid, count(*) AS n FROM dds GROUP BY ok")
def _(spark, d):
    return D.checked_spans(dd_payloads(spark, d)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def coded_payloads(spark, d) -> DataFrame:
    """lineitem as dictionary-coded payloads, some with an index out of range."""
    c = F.col
    span = F.struct(
        F.lit(0).alias("service"), F.lit(1).alias("name"), F.lit(2).alias("resource"),
        (c("l_orderkey") + 1).alias("trace_id"), (c("l_partkey") + 1).alias("span_id"), F.lit(0).alias("parent_id"),
        F.lit(5).alias("start"), c("l_quantity").cast("bigint").alias("duration"), F.lit(0).alias("error"),
        F.create_map(F.lit("3"), F.when(c("l_linenumber") == 5, 9).otherwise(4)).alias("meta"),
        F.create_map(F.lit("4"), c("l_discount")).alias("metrics"), F.lit(1).alias("type"),
    ).cast(dd.CODED_SPAN)
    words = F.array(c("l_returnflag"), F.lit("op"), c("l_linestatus"), F.lit("flag"), F.concat("l_returnflag", "l_linestatus"))
    return v.spread(v.table(spark, d, "lineitem")).select(
        F.lit(1).cast("bigint").alias("project_id"), F.lit(9).cast("bigint").alias("received_at_ms"),
        words.alias("dictionary"), F.array(F.array(span)).alias("traces"),
    )


@query("expand_dictionary", sql="""SELECT l_returnflag AS service_name, 'op' AS name, l_linestatus AS message,
  l_returnflag || l_linestatus AS flag, l_discount AS discount, CAST(l_quantity AS BIGINT) AS duration_ns
  FROM lineitem WHERE l_linenumber <> 5""")
def _(spark, d):
    return shown_coded(coded_payloads(spark, d))


def shown_coded(payloads: DataFrame) -> DataFrame:
    rows = D.flatten_ddtrace(D.expand_dictionary(payloads))
    fields = F.try_variant_get("fields", "$", "map<string,variant>")
    return rows.withColumn("f", fields).select(
        "service_name", "name", "message",
        F.try_variant_get(F.col("f")["attribute.flag"], "$", "string").alias("flag"),
        F.try_variant_get(
            F.col("f")[F.concat(F.lit("attribute."), "service_name", "message")], "$", "double"
        ).alias("discount"),
        "duration_ns",
    )


@query("reject_counts", LI, DOC, EO, DDS, sql="""SELECT 'otlp.invalid_span' AS reason, count(*) AS rejected FROM li WHERE NOT ok
  UNION ALL SELECT 'otlp.invalid_log', count(*) FROM doc WHERE NOT ok
  UNION ALL SELECT 'otlp.invalid_metric_point', count(*) FROM ep WHERE NOT ok
  UNION ALL SELECT 'ddtrace.invalid_span', count(*) FROM dds WHERE NOT ok
  UNION ALL SELECT 'malformed', count(*) FROM lineitem WHERE l_linenumber = 5""")
def _(spark, d):
    return O.reject_counts(
        O.rejects(li_otel(spark, d), "traces"),
        O.rejects(doc_otel(spark, d), "logs"),
        O.rejects(ev_otel(spark, d), "metrics"),
        D.rejects(dd_payloads(spark, d)),
        D.malformed_payloads(coded_payloads(spark, d)),
    )


# --- envelopes ------------------------------------------------------------------

def doc_bodies(spark, d) -> DataFrame:
    """documents as envelope texts: an error event and a log batch of two entries each; every
    tenth has a wrong item count."""
    n = F.col("doc_id")
    log = F.to_json(F.struct(
        (n * 1.5).alias("timestamp"), F.lit("warn").alias("level"), F.col("text").alias("body"),
        F.lit("b" * 32).alias("trace_id"),
        F.struct(F.struct(F.col("lang").alias("value")).alias("lang")).alias("attributes"),
    ))
    logs = F.concat(F.lit('{"version":2,"items":['), log, F.lit(","), log, F.lit("]}"))
    event = F.to_json(F.struct(
        n.alias("timestamp"), F.struct(F.array(F.struct(
            F.lit("DocError").alias("type"), F.col("source").alias("value"),
            F.struct(F.array(F.struct(F.col("lang").alias("filename"), F.lit("run").alias("function"), F.lit(True).alias("in_app"))).alias("frames")).alias("stacktrace"),
        )).alias("values")).alias("exception"),
        F.struct(n.cast("string").alias("id")).alias("user"),
    ))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit('{"event_id":"'), F.md5(n.cast("string")), F.lit('"}')),
        F.lit('{"type":"event"}'), event,
        F.concat(F.lit('{"type":"log","item_count":'), F.when(n % 10 == 0, "3").otherwise("2"), F.lit(',"length":'),
                 F.octet_length(logs).cast("string"), F.lit("}")), logs,
        F.lit('{"type":"session"}'), F.lit("{}"),
    )
    return v.spread(v.table(spark, d, "documents")).select("doc_id", "source", lines.alias("body"))


def doc_envelopes(spark, d) -> DataFrame:
    return frame_envelopes(doc_bodies(spark, d).select(
        F.col("doc_id").cast("string").alias("envelope_id"), F.lit(1).cast("bigint").alias("project_id"),
        F.lit(9).cast("bigint").alias("received_at_ms"), F.encode("body", "UTF-8").alias("body"),
    ))


def item_envelopes(spark, d) -> DataFrame:
    """benchmark items as envelope texts: an event, or a line break in its payload, or a length that is wrong."""
    n, broken = F.col("item_id"), F.col("item_id") % 5 == 0
    event = F.to_json(F.struct(n.alias("timestamp"), F.struct(F.col("text").alias("formatted")).alias("logentry")))
    event = F.when(n % 2 == 0, F.concat(F.lit("{\n"), F.substring(event, 2, 1 << 30))).otherwise(event)
    length = F.octet_length(event) + F.when(broken, 99).otherwise(0)
    head = F.concat(F.lit('{"event_id":"'), F.md5(n.cast("string")), F.lit('"}'))
    return v.table(spark, d, "benchmark").select(
        F.concat_ws("\n", head, F.concat(F.lit('{"type":"event","length":'), length.cast("string"), F.lit("}")), event).alias("value")
    )


FILED = """SELECT md5(CAST(item_id AS VARCHAR)) AS id, item_id * 1000000000 AS ts_nano, md5(text) AS message_md5 FROM benchmark WHERE item_id % 5 <> 0"""


def filed(framed: DataFrame) -> DataFrame:
    return E.events_to_errors(framed).select("id", "ts_nano", F.md5("message").alias("message_md5"))


@query("read_envelopes", sql=FILED)
def _(spark, d):
    """Envelope files, every one of its own, gzip among them."""
    base, bodies = LineageCut(spark).new_path(), item_envelopes(spark, d)
    for part, codec in enumerate(("none", "gzip")):
        rows = bodies.where(F.pmod(F.hash("value"), F.lit(2)) == part)
        rows.write.mode("append").option("maxRecordsPerFile", 1).option("compression", codec).text(base)
    return filed(read_envelopes(spark, base, 1, 9))


@query("stream_envelopes", sql=FILED)
def _(spark, d):
    """The same files in two arrivals, a few in each batch, with a restart between them."""
    base, bodies = LineageCut(spark).new_path(), item_envelopes(spark, d)
    for part, codec in enumerate(("none", "gzip")):
        rows = bodies.where(F.pmod(F.hash("value"), F.lit(2)) == part)
        rows.write.mode("append").option("maxRecordsPerFile", 1).option("compression", codec).text(f"{base}/in")
        stream = filed(stream_envelopes(spark, f"{base}/in", 1, 9, files_per_batch=60))
        run_available(stream.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("reject_reasons", sql="""SELECT 'malformed' AS reason, count(*) AS rejected FROM benchmark WHERE item_id % 5 = 0""")
def _(spark, d):
    bodies = item_envelopes(spark, d).select(
        F.md5("value").alias("envelope_id"), F.lit(1).cast("bigint").alias("project_id"), F.lit(9).cast("bigint").alias("received_at_ms"),
        F.encode("value", "UTF-8").alias("body"),
    )
    return O.reject_counts(E.rejects(frame_envelopes(bodies)))


@query("events_to_errors", sql="""SELECT md5(CAST(doc_id AS VARCHAR)) AS id, doc_id * 1000000000 AS ts_nano, 'error' AS level,
  'DocError: ' || source AS title, source AS message, 'DocError' AS error_type,
  replace('DocError~~run~' || lang, '~', chr(0)) AS fingerprint, CAST(doc_id AS VARCHAR) AS user_id
  FROM documents WHERE doc_id % 10 <> 0""")
def _(spark, d):
    rows = E.events_to_errors(doc_envelopes(spark, d))
    return rows.select(
        "id", "ts_nano", "level", "title", "message", "error_type", F.col("issue_fingerprint").alias("fingerprint"),
        F.try_variant_get("fields", '$["user.id"]', "string").alias("user_id"),
    )


@query("explode_items", sql="""SELECT CAST(floor(doc_id * 1.5e9) AS BIGINT) AS ts_nano, 'warn' AS level, md5(text) AS message_md5, lang,
  n AS copies FROM documents, (SELECT unnest([1, 2]) AS n) WHERE doc_id % 10 <> 0""")
def _(spark, d):
    rows = E.explode_items(doc_envelopes(spark, d), "log")
    rows = rows.select(
        "id", "ts_nano", "level", F.md5("message").alias("message_md5"),
        F.try_variant_get("fields", '$["attribute.lang"]', "string").alias("lang"),
    )
    # Two entries per envelope with two different ids.
    pair = rows.groupBy("ts_nano", "level", "message_md5", "lang").agg(F.count_distinct("id").alias("ids"))
    return pair.select(
        "ts_nano", "level", "message_md5", "lang", F.explode(F.sequence(F.lit(1), F.col("ids").cast("int"))).alias("copies")
    )


@query("validate_envelope", sql="""SELECT 'malformed' AS reason, count(*) AS rejected FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT 'session', count(*) FROM documents WHERE doc_id % 10 <> 0""")
def _(spark, d):
    return O.reject_counts(E.rejects(doc_envelopes(spark, d)))


@query("counter_to_sum", sql="""SELECT event_id, CASE WHEN event_type = 'click' THEN 'sum' ELSE 'gauge' END AS type,
  CASE WHEN event_type = 'click' THEN 'delta' END AS temporality, CASE WHEN event_type = 'click' THEN true END AS monotonic
  FROM events""")
def _(spark, d):
    counter = F.col("event_type") == "click"
    mapped = E.counter_to_sum(counter, E.V.of(F.lit("gauge")))
    return v.table(spark, d, "events").select(
        "event_id", E.V.as_string(mapped["type"]).alias("type"), E.V.as_string(mapped["temporality"]).alias("temporality"),
        E.V.as_bool(mapped["monotonic"]).alias("monotonic"),
    )


# --- scalar functions --------------------------------------------------------------

@query("code_names", sql=f"""SELECT l_linenumber AS code, {KIND_SQL} AS span_kind,
  CASE l_linenumber WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status,
  CASE l_linenumber WHEN 1 THEN 'delta' WHEN 2 THEN 'cumulative' ELSE 'unspecified' END AS temporality, count(*) AS n
  FROM lineitem GROUP BY ALL""")
def _(spark, d):
    code = F.col("l_linenumber")
    return v.table(spark, d, "lineitem").groupBy(
        code.alias("code"), S.span_kind(code).alias("span_kind"), S.status_code(code).alias("status"),
        S.temporality_name(code).alias("temporality"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("finite_numbers", sql="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '"NaN"' WHEN 1 THEN '"Infinity"' WHEN 2 THEN '"-Infinity"'
  ELSE 'number' END AS shown FROM events""")
def _(spark, d):
    n = F.col("event_id") % 4
    value = F.when(n == 0, float("nan")).when(n == 1, float("inf")).when(n == 2, float("-inf")).otherwise(F.col("value"))
    shown = S.finite_number(value)
    return v.table(spark, d, "events").select(
        "event_id", F.when(n == 3, F.when(E.V.is_number(shown), "number")).otherwise(F.to_json(shown)).alias("shown")
    )


@query("any_values", sql="""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN CAST(event_id AS VARCHAR)
  WHEN 2 THEN 'true' WHEN 3 THEN '[' || CAST(event_id AS VARCHAR) || ',"x"]'
  ELSE '[{"key":"k","value":"' || event_type || '"}]' END AS shown FROM events""")
def _(spark, d):
    from signaldeck.sources.otel import any_value_ddl

    n, kind = F.col("event_id"), F.col("event_type")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit('{"string_value":"'), kind, F.lit('"}')))
        .when(n % 5 == 1, F.concat(F.lit('{"int_value":'), n.cast("string"), F.lit("}")))
        .when(n % 5 == 2, F.lit('{"bool_value":true}'))
        .when(n % 5 == 3, F.concat(F.lit('{"array_value":{"values":[{"int_value":'), n.cast("string"), F.lit('},{"string_value":"x"}]}}')))
        .otherwise(F.concat(F.lit('{"kvlist_value":{"values":[{"key":"k","value":{"string_value":"'), kind, F.lit('"}}]}}')))
    )
    rows = v.table(spark, d, "events").select("event_id", F.from_json(text, any_value_ddl()).alias("v"))
    return rows.select("event_id", F.to_json(O.any_value(F.col("v"))).alias("shown"))


@query("last_wins_attributes", sql="""SELECT event_id, event_type AS a, CAST(event_id AS VARCHAR) AS b FROM events""")
def _(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), E.V.of(value).alias("value"))
    pairs = F.array(pair("a", n.cast("string")), pair("b", n.cast("string")), pair("a", kind))
    rows = v.table(spark, d, "events").select("event_id", E.V.map_of_pairs(pairs).alias("m"))
    return rows.select("event_id", E.V.as_string(F.col("m")["a"]).alias("a"), E.V.as_string(F.col("m")["b"]).alias("b"))


@query("trace_ids_128", sql="""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '00000000000000ab' ELSE '' END ||
  lpad(lower(to_hex(c_custkey)), 16, '0') AS trace_id FROM customer""")
def _(spark, d):
    n = F.col("c_custkey")
    high = F.when(n % 3 == 0, "00000000000000AB").when(n % 3 == 1, "0g")
    return v.table(spark, d, "customer").select("c_custkey", S.trace_id_128(n, high).alias("trace_id"))


@query("event_times", sql="""SELECT event_id, epoch_us(ts) * 1000 + 789 AS text_nano, event_id * 1000000000 + 500000000 AS number_nano,
  event_id * 1000000 AS arrival_nano FROM events""")
def _(spark, d):
    text = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    n = F.col("event_id")
    at = lambda value: E.event_time(value, n)
    return v.table(spark, d, "events").select(
        "event_id", at(E.V.of(text)).alias("text_nano"), at(E.V.of(n + F.lit(0.5))).alias("number_nano"),
        at(F.lit(None).cast("variant")).alias("arrival_nano"),
    )


@query("durations", sql="""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN p_partkey * 60000
  WHEN 2 THEN p_partkey * 3600000 WHEN 3 THEN p_partkey * 86400000 WHEN 4 THEN p_partkey * 604800000 END AS ms FROM part""")
def _(spark, d):
    n = F.col("p_partkey")
    unit = F.element_at(F.array(*map(F.lit, "smhdwx")), (n % 6 + 1).cast("int"))
    return v.table(spark, d, "part").select("p_partkey", S.duration_ms(F.concat(n.cast("string"), unit)).alias("ms"))


@query("span_listing", LI, sql=f"""SELECT trace_id || '-' || span_id AS id, l_returnflag || l_linestatus AS text,
  l_returnflag AS origin, {STATUS_SQL} AS status, {duration_sql('(CAST(l_quantity AS BIGINT) * 1000000)')} AS duration
  FROM li WHERE ok""")
def _(spark, d):
    from signaldeck.operators.listing import listing

    return listing(O.flatten_spans(li_otel(spark, d))).select("id", "text", "origin", "status", "duration")
