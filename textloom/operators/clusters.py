"""Greedy clusters of similar names by a prefix-filter join, without a task that holds a whole block.

A similarity of r > ``least`` (twice the matched characters over both lengths)
leaves few unmatched characters, hence few gaps between matching blocks, hence
many pairs of neighbouring characters in common: with S characters together, at
least 3 * (floor(least * S / 2) + 1) - S - 1, which is over 0 from 0.8 on. So two such names share one of the
rarest pairs of either, and only these are joined; lengths and then the true
ratio are tested on what meets.

The greedy rule, best confidence first, makes a name a leader unless an earlier
leader is near. It is followed in rounds over the near pairs: names before which
no undecided one is near become leaders, their neighbours don't, and so on, until
all are decided. Each member then joins its first near leader.

Defined results: null values are left out, null blocks are a block of their own,
null confidences come last; values that differ in case alone are one name;
repeated rows add to the mentions; an empty table gives no rows.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.normalize import normalized
from textloom.sources.shared import settle


def _grams(names: DataFrame) -> DataFrame:
    """(block, name, gram, k): pairs of neighbouring characters, the k-th of its kind in the name."""
    starts = F.sequence(F.lit(1), F.length("name") - 1)
    each = names.where(F.length("name") > 1).select("block", "name", F.explode(F.transform(starts, lambda i: F.substring("name", i, 2))).alias("gram"))
    counted = each.groupBy("block", "name", "gram").agg(F.count("*").cast("int").alias("n"))
    return counted.select("block", "name", "gram", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


def candidates(names: DataFrame, least: float) -> DataFrame:
    """(block, a, b): pairs that may be near, a before b, from (block, name, place)."""
    grams = _grams(names)
    rarity = grams.groupBy("block", "gram", "k").agg(F.count("*").alias("df"))
    listed = grams.join(rarity, ["block", "gram", "k"]).groupBy("block", "name").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "k"))).alias("grams"))
    size = F.size("grams") + 1
    # The shortest partner gives the least number of pairs in common.
    need = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * 2 / (2 - least) * size - 1 - 1e-9).cast("int"))
    rare = F.slice("grams", 1, F.greatest(size - need, F.lit(0)))
    firsts = listed.join(names, ["block", "name"]).select("block", "name", "place", size.alias("size"), F.posexplode(rare).alias("at", "g"))
    firsts = firsts.select("block", "g.gram", "g.k", "name", "place", "size", (F.col("size") - 1 - F.col("at")).alias("rest"))  # pairs from here on
    late = firsts.withColumnsRenamed({"name": "b", "place": "late", "size": "size_b", "rest": "rest_b"})
    met = firsts.withColumnRenamed("name", "a").join(late, ["block", "gram", "k"])
    both = F.col("size") + F.col("size_b")
    common = 3 * (F.floor(least * both / 2) + 1) - both - 1
    # Where two names first meet, what is left of either bounds what they have in common.
    able = (2 * F.least("size", "size_b") > least * both) & (F.least("rest", "rest_b") >= common)
    return met.where((F.col("place") < F.col("late")) & able).select("block", "a", "b").distinct()


def near_pairs(names: DataFrame, least: float) -> DataFrame:
    """(block, a, b): pairs of names with b more than ``least`` similar to a, which comes before it."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                match = difflib.SequenceMatcher(None, b, a)
                keep.append(match.quick_ratio() > least and match.ratio() > least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return candidates(names, least).mapInArrow(test, "block string, a string, b string")


def first_free(pairs: DataFrame) -> DataFrame:
    """(block, name): of the names in pairs, those that are chosen if each is unless one chosen before it is near."""
    of = lambda df, c: df.select("block", F.col(c).alias("name"))
    at = lambda df, c: df.select("block", F.col("name").alias(c))
    undecided = of(pairs, "a").union(of(pairs, "b")).distinct()
    chosen = []
    while True:
        left = pairs.join(at(undecided, "a"), ["block", "a"], "left_semi").join(at(undecided, "b"), ["block", "b"], "left_semi")
        later = of(left, "b").distinct()
        hit = of(left.join(at(later, "a"), ["block", "a"], "left_anti"), "b").distinct()
        # One table a round: later names wait, unless a free one before them is near.
        told = undecided.join(later.withColumn("later", F.lit(True)), ["block", "name"], "left").join(hit.withColumn("hit", F.lit(True)), ["block", "name"], "left")
        told = settle(told)
        chosen.append(told.where("later IS NULL").select("block", "name"))
        undecided = told.where("later AND hit IS NULL").select("block", "name")
        if undecided.isEmpty():
            return reduce(DataFrame.union, chosen)


def similarity_clusters(rows: DataFrame, block: Column, value: str, confidence: str, least: float = 0.85) -> DataFrame:
    """(block, leader, size, mentions, members): a value joins the first leader more than ``least`` similar, or leads."""
    if least < 0.8:
        raise ValueError("less similar names may have no pair of neighbouring characters in common")
    key = F.coalesce(F.concat(F.lit("="), block.cast("string")), F.lit(""))
    values = settle(rows.where(F.col(value).isNotNull()).groupBy(key.alias("block"), F.col(value).alias("value")).agg(F.max(confidence).cast("double").alias("best"), F.count("*").alias("mentions")).withColumn("name", F.lower("value")))
    place = F.struct(F.col("best").isNull().alias("none"), (-F.col("best")).alias("best"), "value")
    names = settle(values.groupBy("block", "name").agg(F.min(place).alias("place")))
    pairs = settle(near_pairs(names, least))
    chosen = first_free(pairs)
    first = pairs.join(chosen.withColumnRenamed("name", "a"), ["block", "a"], "left_semi").join(names.withColumnRenamed("name", "a"), ["block", "a"])
    joined = first.groupBy("block", F.col("b").alias("name")).agg(F.min("place").alias("lead"))
    of = names.join(chosen.withColumn("leads", F.lit(True)), ["block", "name"], "left").join(joined, ["block", "name"], "left")
    lead = F.when(F.col("leads").isNotNull() | F.col("lead").isNull(), F.col("place")).otherwise(F.col("lead"))
    placed = values.join(of.select("block", "name", lead["value"].alias("leader")), ["block", "name"])
    found = placed.groupBy("block", "leader").agg(F.count("*").alias("size"), F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set("value")).alias("members"))
    return found.withColumn("block", F.when(F.col("block") != "", F.substr("block", F.lit(2))))


def merged(rows: DataFrame, by: list[str], value: str, confidence: str, kind: Column, certain: Column | None = None) -> DataFrame:
    """(by, entity_value, confidence, size, mentions): one entity for each cluster, adding up before anything is shuffled.

    The surest value, of equals the smallest, stands for the cluster, written as
    its type is; it is no surer than ``certain``, the confidence of that spelling
    (default 1). Null values count in size alone; null confidences come last, as 0.
    """
    sure = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-sure).alias("c"), F.col(value).alias("v"), kind.alias("k"), (F.lit(1.0) if certain is None else certain).alias("s"))))
    found = rows.groupBy(*by).agg(best.alias("b"), F.count("*").alias("size"), F.count_distinct(value).alias("mentions"))
    return found.select(*by, normalized(F.col("b.v"), F.col("b.k")).alias("entity_value"), F.least(-F.col("b.c"), F.col("b.s")).alias("confidence"), "size", "mentions")


def merged_lists(rows: DataFrame, by: list[str], value: str, metadata: str) -> DataFrame:
    """(by, key, value, times): a cluster's metadata of maps of lists, list by list, and its values as original_mentions.

    Each distinct value is a row with how often it was listed, so that the lists
    of a cluster of any size are added up by parts. Null maps and lists are empty;
    null members are values.
    """
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,array<string>>")), lambda k, v: k != "original_mentions")
    listed = F.map_concat(own, F.create_map(F.lit("original_mentions"), F.filter(F.array(F.col(value).cast("string")), lambda v: v.isNotNull())))
    each = rows.select(*by, F.explode(listed).alias("key", "_l")).select(*by, "key", F.explode("_l").alias("value"))
    return each.groupBy(*by, "key", "value").agg(F.count("*").alias("times"))


def as_maps(lists: DataFrame, by: list[str]) -> DataFrame:
    """(by, metadata): merged_lists() as one map of lists of distinct values a cluster; such a row holds all of a cluster's values."""
    kept = lists.groupBy(*by, "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return kept.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("metadata"))
