"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least vertex around: those above each vertex (large), or those below with it (small).

    ``edges`` has b < a once an edge. The least neighbour comes from an aggregation that is combined
    before its shuffle, so that a vertex with many edges doesn't gather them in one place.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b); no row for other nodes.

    Self-links and repeated links are allowed; an empty table gives an empty result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if (row["n"], row["x"]) == before or not row["n"]:
            break
        before = (row["n"], row["x"])
        read, now = now, materialize(_star(_star(now, True), False), "edges")
        discard(edges.sparkSession, read.scratch_path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
