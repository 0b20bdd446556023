"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    ends = edges.select(F.col(source).alias("node")).union(edges.select(target))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def metrics(edges: DataFrame, source: str, target: str) -> DataFrame:
    """nodes, edges, average degree and density."""
    both = degrees(edges, source, target).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"))
    n = F.col("nodes")
    return both.select("nodes", "edges", F.round(2 * F.col("edges") / n, 6).alias("avg_degree"), F.round(F.try_divide(2 * F.col("edges"), n * (n - 1)), 9).alias("density"))


def valid_edges(edges: DataFrame, nodes: DataFrame, source: str, target: str, key: str) -> DataFrame:
    keys = nodes.select(F.col(key).alias("_x")).distinct()
    return edges.join(keys, F.col(source) == F.col("_x"), "left_semi").join(keys, F.col(target) == F.col("_x"), "left_semi")


def reachable(edges: DataFrame, start: DataFrame, source: str, target: str, hops: int) -> DataFrame:
    """(node, hops): least number of steps from the start nodes, up to hops; each round joins the frontier alone."""
    seen = frontier = start.toDF("node").distinct().withColumn("hops", F.lit(0))
    for i in range(1, hops + 1):
        step = edges.join(frontier, F.col(source) == F.col("node")).select(F.col(target).alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("hops", F.lit(i))
        seen = seen.union(frontier)
    return seen
