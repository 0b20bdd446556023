"""Connected components of an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
step replaces a node's edges by edges to the least node it sees, so the number
of edges never grows beyond the input and the rounds needed grow with the
logarithm of the size. Minima are combined before the shuffle, and a node with
very many neighbours is one row on the smaller side of a join, which adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settle, shuffled


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    return both.join(shuffled(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(shuffled(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node with an edge, the least node of its component.

    Self-loops, repeated edges, edges with a null and either direction are
    allowed; an empty table gives no rows. Roots themselves are listed.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = settle(edges)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before, now = None, mark(edges)
    while now[0] and now != before:
        edges = settle(_small(_large(edges)))
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
