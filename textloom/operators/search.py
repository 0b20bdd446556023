"""Vector, keyword and entity search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vectors import cosine, trigram_similarity
from textloom.sources.tables import text_match


def similar(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector with its cosine similarity to the one query vector, a row of column q.

    One row is broadcast whatever the size of the table, which is read once.
    """
    return vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")


def top_k(found: DataFrame, k: int, *order) -> DataFrame:
    return found.orderBy(*order).limit(k)


def top_k_per(found: DataFrame, group: str, k: int, *order) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def entities(table: DataFrame, value: str, term: str, confidence: str, key: str, k: int = 20) -> DataFrame:
    """Rows whose value contains the term, with how often the value occurs among them; best first."""
    found = table.where(text_match([value], term))
    found = found.withColumn("occurrences", F.count("*").over(Window.partitionBy(value)))
    found = found.withColumn("similarity", F.round(trigram_similarity(F.col(value), F.lit(term)), 6))
    return found.orderBy(F.desc("occurrences"), F.desc(confidence), F.desc("similarity"), key).limit(k)


def keyword_score(table: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Share of the terms that a text contains, rows without any left out."""
    low = F.lower(text)
    score = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    return table.withColumn("score", F.round(score / len(terms), 6)).where("score > 0")
