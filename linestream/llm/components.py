"""Connected components by alternating stars, on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.llm.common import written


def _to_least(pairs: DataFrame, *take) -> DataFrame:
    """Joins each u of ``pairs`` (u, v) with m, the least of it and its neighbours; gives the pairs that ``take`` makes of (u, v, m)."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    made = pairs.join(least, "u").select(F.explode(F.array(*take)).alias("e"))
    return made.select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct()


def _pair(u, v):
    return F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it is connected with.

    Large stars, then small stars, until nothing changes: a number of rounds like the logarithm of the longest
    chain.  Minima are combined before the shuffle, and the joins split by adaptive execution, so a node with very many
    neighbours is spread.  Each round is written to the shared folder.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        # Each pair in both directions comes from one row: no union, whose claimed partitioning later steps would rely on.
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        large = _to_least(both.select("e.u", "e.v"), F.when(F.col("v") > F.col("u"), _pair("v", "m")).otherwise(_pair("m", "m")))
        now = written(_to_least(large, _pair("v", "m"), _pair("u", "m")), "stars")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    ends = F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), "v"))
    nodes = now.select(F.explode(ends).alias("e")).select("e.node", F.col("e.v").alias("component"))
    return nodes.distinct()
