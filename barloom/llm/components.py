"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import drop_table, materialize


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of edges; only edges that agree in both are compared."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that has an edge to another; ``component`` is the smallest node reachable.

    Each round links every node's larger neighbours to the node's smallest one, then its smaller
    neighbours likewise. Rounds go on until the edges no longer change; then every component is a
    star around its smallest node. A round's edges are written to the shared folder. Smallest
    neighbours are aggregated before the shuffle, and nodes meet them in a join, so a hub's
    neighbours are never gathered. Null ends and loops are left out.
    """
    first = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = materialize(first, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "hub")
        large = both.filter("v > u").join(least, F.col("u") == F.col("hub")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
        small = large.join(low, F.col("u") == F.col("hub")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        before, mark = mark, _mark(after)
        ended = mark == before and after.join(now.select(F.col("u").alias("x"), F.col("v").alias("y")), (F.col("u") == F.col("x")) & (F.col("v") == F.col("y")), "left_anti").isEmpty()
        drop_table(now)
        now = after
        if ended:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
