"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signaldeck.llm.common import tables


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (a, b); root is the smallest id of its component.

    Each round replaces every node by its neighbour with the smallest hash, if that is
    smaller than its own, and drops what became a loop.  Hash order makes long chains
    shrink as fast as stars, so that rounds grow with the logarithm of the nodes.  Nothing
    but the number of edges left reaches the driver; rounds are cut by written tables.
    """
    written = tables(edges.sparkSession)
    edges = written.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = written.save(ids.select("id", F.col("id").alias("label")))
    edges = edges.where("a <> b")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        moved = near.where(F.col("best") < rank("a")).select(F.col("a").alias("old"), F.col("best.id").alias("new"))
        moved = written.save(moved)
        to = lambda side: moved.select(F.col("old").alias(f"{side}_old"), F.col("new").alias(f"{side}_new"))  # noqa: B023,E731
        stepped = edges.join(to("a"), F.col("a") == F.col("a_old"), "left").join(to("b"), F.col("b") == F.col("b_old"), "left")
        stepped = stepped.select(F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b")).where("a <> b")
        edges = written.save(stepped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = labels.join(moved, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
        labels = written.save(labels)
    smallest = labels.groupBy(F.col("label").alias("of")).agg(F.min("id").alias("root"))
    return labels.join(smallest, F.col("label") == F.col("of")).select("id", "root")
