"""Joins with a meaning: access rules, anti and existence joins, bands, and intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def secured(rows: DataFrame, owner: str, user: int, key: str, grants: DataFrame) -> DataFrame:
    """Rows that the user owns or was granted: the key stands in grants."""
    granted = grants.select(F.col(key).alias("_granted")).distinct()
    joined = rows.join(granted, F.col(key) == F.col("_granted"), "left")
    return joined.where((F.col(owner) == user) | F.col("_granted").isNotNull()).drop("_granted")


def without(rows: DataFrame, unwanted: DataFrame, key: str, other: str) -> DataFrame:
    return rows.join(unwanted.select(F.col(other).alias("_x")), F.col(key) == F.col("_x"), "left_anti")


def flagged(rows: DataFrame, others: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """A boolean column: whether the key stands among the others."""
    keys = others.select(F.col(other).alias("_x")).distinct()
    return rows.join(keys, F.col(key) == F.col("_x"), "left").withColumn(name, F.col("_x").isNotNull()).drop("_x")


def band_join(left: DataFrame, right: DataFrame, on: str, a: str, b: str, width: int) -> DataFrame:
    """Pairs of equal ``on`` with |a - b| <= width: an equi join on buckets of that width, then the exact test.

    The right side is listed under its bucket and both neighbours, so no pair is
    missed or found twice; a group's pairs are only formed within its buckets.
    """
    x = left.withColumn("_bucket", F.floor(F.col(a) / width))
    y = right.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(b) / width) + i for i in (-1, 0, 1)])))
    return x.join(y, [on, "_bucket"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_bucket")


def merged_intervals(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a group as one: islands after a running maximum."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def first_spans(rows: DataFrame, group: list[str], start: str, end: str, share: float = 0.5, best: str | None = None) -> DataFrame:
    """Greedy choice per group: a span goes if it overlaps a chosen one by more than share of the shorter.

    Earliest starts first, or greatest ``best`` first where given. A group is
    the spans of one text and type, which bounds it.
    """

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([best, start, end] if best else [start, end], ascending=[False, True, True] if best else [True, True])
        kept: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(part[start], part[end]):
            free = all(min(b, y) - max(a, x) <= share * min(b - a, y - x) for x, y in kept)
            keep.append(free)
            if free:
                kept.append((a, b))
            if not best:  # starts only grow: chosen spans that end before this one can't overlap later ones
                kept = [s for s in kept if s[1] > a]
        return part[keep]

    return rows.groupBy(*group).applyInPandas(choose, rows.schema)
