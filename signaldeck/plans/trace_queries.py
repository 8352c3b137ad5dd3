"""Trace-tree queries over order lines and conversations seen as spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from signaldeck.operators.traces import trace_tree
from signaldeck.plans import views as v
from signaldeck.plans.registry import query

LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def li_spans(spark, d):
    """Order lines as spans: line n hangs under line n div 2 of its order.

    Line numbers repeat within an order, so spans share ids and parents may be missing.
    """
    line = F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    us = v.epoch_micros(F.col("l_shipdate"))
    return v.table(spark, d, "lineitem").select(
        F.lit(1).cast("bigint").alias("project_id"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        F.concat_ws("-", line, "l_partkey", "l_suppkey", cents, us).alias("id"),
        (us * 1_000).alias("ts_nano"),
        line.cast("string").alias("span_id"),
        F.call_function("div", line, F.lit(2)).cast("string").alias("parent_span_id"),
    )


LS = """RECURSIVE ls AS (SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT), epoch_us(l_shipdate)) AS id, epoch_us(l_shipdate) * 1000 AS ts,
    l_linenumber AS span, l_linenumber // 2 AS up FROM lineitem),
  ow AS (SELECT trace_id, span, arg_min(id, struct_pack(ts, id)) AS id FROM ls GROUP BY ALL),
  nd AS (SELECT ls.trace_id, ls.id, ls.ts, ow.id AS parent FROM ls LEFT JOIN ow ON ow.trace_id = ls.trace_id AND ow.span = ls.up),
  tr AS (SELECT trace_id, id, 0 AS depth, [struct_pack(ts, id)] AS path FROM nd WHERE parent IS NULL
    UNION ALL SELECT nd.trace_id, nd.id, tr.depth + 1, list_append(tr.path, struct_pack(ts := nd.ts, id := nd.id))
    FROM nd JOIN tr ON nd.trace_id = tr.trace_id AND nd.parent = tr.id)"""


@query("trace_tree", LS, sql="""SELECT trace_id, id, CAST(depth AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM tr""")
def _(spark, d):
    return trace_tree(li_spans(spark, d)).select("trace_id", "id", "depth", "position")


def conv_spans(spark, d):
    """Turns as a chain per conversation; every third one closes to a ring."""
    turn, conv = F.col("turn"), F.col("conv_id")
    parent = F.when((turn == 0) & (conv % 3 == 0), F.lit("0")).otherwise((turn - 1).cast("string"))
    return v.table(spark, d, "conversations").select(
        (conv % 2).alias("project_id"), conv.cast("string").alias("trace_id"),
        F.concat_ws("-", conv, turn).alias("id"), turn.alias("ts_nano"),
        turn.cast("string").alias("span_id"), parent.alias("parent_span_id"),
    )


@query("trace_tree_rings", sql="""SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
  turn AS depth, turn AS position FROM conversations""")
def _(spark, d):
    return trace_tree(conv_spans(spark, d)).select("trace_id", "id", "depth", "position")


@query("trace_tree_tour", LS, sql="""SELECT trace_id, id, CAST(depth AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM tr""")
def _(spark, d):
    """The same tree, from many ranges, whose bounds cut through traces."""
    return trace_tree(li_spans(spark, d), ranges=61).select("trace_id", "id", "depth", "position")


LS_ONE = LS.replace("CAST(l_orderkey AS VARCHAR) AS trace_id, concat_ws('-',", "'all' AS trace_id, concat_ws('-', l_orderkey,")


@query("trace_tree_one", LS_ONE, sql="""SELECT id, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY path) - 1 AS position FROM tr""")
def _(spark, d):
    """All order lines as one trace, in which a span has a large share of all rows as children."""
    spans = li_spans(spark, d).withColumn("id", F.concat_ws("-", "trace_id", "id"))
    return trace_tree(spans, ["project_id"]).select("id", "depth", "position")
