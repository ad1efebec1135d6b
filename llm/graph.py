"""Connected components by alternating star contraction, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import store


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) to (u, root): each node with an edge to another, and its component's least node.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour. A star
    with many leaves is joined to one row, which adaptive execution splits. Ends when nothing changes.
    """
    e = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        e = store(small.where("u <> v").distinct(), "edges")
        if (now := _mark(e)) == mark:
            break
        mark = now
    return e.select("u", F.col("v").alias("root"))
