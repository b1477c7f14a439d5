"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import cut, hinted, uncut


def _least(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("a").agg(F.min("b").alias("m")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge to another, with the smallest node of its component.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the least node it knows, until
    nothing changes; the rounds grow with the logarithm of the size. Each round is a written table, so a lost executor
    costs one round, and the tables of a round go when the next is written. The least node of each neighbourhood is
    aggregated map-side, and joined to the edges by broadcast when it is small in bytes, else by a join whose large keys
    the engine splits; no neighbourhood is gathered anywhere.
    Null ends, loops and repeated edges add nothing; no edges give an empty table.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now = cut(now.distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    mark = sign(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = cut(both.join(hinted(least), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b"))
        lower = _least(large)
        small = large.join(hinted(lower), "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        uncut(now, least, large, lower)
        now = after
        before, mark = mark, sign(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
