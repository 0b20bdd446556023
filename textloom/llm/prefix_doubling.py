"""Repeated strings by distributed prefix doubling in its full form, over every byte of every text.

The rank of a position names the bytes from it on, of a length that doubles:
each step sorts the pairs (rank, rank at the offset) and ranks them anew, for
positions whose rank is shared by another document and whose string is still
shorter than the threshold; the last offset is cut so that the lengths meet the
threshold. Positions whose rank is unique go no further. All steps are joins,
windows and aggregates of position rank pairs, several times the texts' size
each, which is why the query over large tables takes ``suffix_dedup``.

Defined results: as in ``suffix_dedup``. Rows that share a doc_id are apart in
their texts and don't mark each other; null ids mark nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import documents_of, settle


def repeated_starts(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """(doc_id, text_hash, at): where a string of threshold bytes starts that also starts in a document of a smaller id."""
    rows = documents_of(docs).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.encode("text", "UTF-8").alias("raw")).distinct()
    places = F.sequence(F.lit(1), F.octet_length("raw"))
    ranks = rows.where(F.octet_length("raw") >= threshold).select("doc_id", "text_hash", F.posexplode(F.transform(places, lambda i: F.conv(F.hex(F.substring("raw", i, F.lit(1))), 16, 10).cast("long"))).alias("at", "rank"))
    length = 1
    while length < threshold:
        step = min(length, threshold - length)
        after = ranks.select("doc_id", "text_hash", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = ranks.join(after, ["doc_id", "text_hash", "at"])
        # Pairs of one document alone are unique: they and what begins with them go no further.
        named = pairs.groupBy("rank", "next").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        shared = pairs.join(named.where("least <> most"), ["rank", "next"])
        if length + step == threshold:
            ranks = shared.where("doc_id > least").select("doc_id", "text_hash", "at")
        else:
            ranks = shared.select("doc_id", "text_hash", "at", F.xxhash64("rank", "next", F.lit(length + step)).alias("rank"))
        ranks = settle(ranks)
        length += step
    return ranks


def removed_bytes(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """doc_id, text_hash, n_removed, n_spans of the texts that lose any byte."""
    own = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    gaps = repeated_starts(docs, threshold).withColumn("gap", F.col("at") - F.lag("at").over(own))
    new = F.col("gap").isNull() | (F.col("gap") > threshold)
    return gaps.groupBy("doc_id", "text_hash").agg(F.sum(F.when(new, threshold).otherwise(F.col("gap"))).alias("n_removed"), F.count_if(new).alias("n_spans"))
