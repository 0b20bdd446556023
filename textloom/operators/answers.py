"""What a question's answer is built from: context and sources of the best pieces, and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import shortened


def contexts(found: DataFrame, key: str, order: list[Column], document: str, page: str, text: str, most: int = 3, limit: int = 500) -> DataFrame:
    """Per question the context text, the sources line and the number of pieces used.

    Only the ``most`` best pieces of a question are gathered, cut at ``limit``
    characters; ``order`` must decide every tie. Missing documents and pages
    are called Unknown.
    """
    ranked = found.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_place") <= most)
    name, at = (F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in (document, page))
    piece = F.concat(F.lit("[Document: "), name, F.lit(", Page: "), at, F.lit("]\n"), shortened(F.coalesce(F.col(text), F.lit("")), limit))
    source = F.concat(name, F.lit(" (Page "), at, F.lit(")"))
    kept = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_place", piece.alias("piece"), source.alias("source")))).alias("p"))
    return kept.select(
        key,
        F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"),
        F.concat(F.lit("**Sources:** "), F.array_join(F.transform("p", lambda x: x["source"]), ", ")).alias("sources"),
        F.size("p").alias("pieces"),
    )


def technical_confidence(context: Column, technical: Column) -> Column:
    """0.9 for a context of over 100 characters, else 0.5; 0.05 more with technical terms, 0.95 at most."""
    base = F.when(F.length(context) > 100, 0.9).otherwise(0.5)
    return F.when(technical, F.least(F.lit(0.95), base + 0.05)).otherwise(base)


def combined_confidence(first: Column, second: Column) -> Column:
    """0.9 where both ways found something, 0.6 for one, 0.3 for none."""
    n = F.when(first, 1).otherwise(0) + F.when(second, 1).otherwise(0)
    return F.when(n == 2, 0.9).when(n == 1, 0.6).otherwise(0.3)


def first_answer(*ways: tuple[Column, float, str]) -> Column:
    """The first way with an answer, with its confidence and name; null if none has one."""
    return F.coalesce(*[F.when(F.length(a) > 0, F.struct(a.alias("answer"), F.lit(c).alias("confidence"), F.lit(n).alias("way"))) for a, c, n in ways])
