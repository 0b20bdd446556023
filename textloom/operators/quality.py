"""Entity quality: part scores, the weighted total, and why an entity fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import length_score

#: Weights of the part scores and default thresholds (fixed values).
WEIGHTS = {"confidence": 0.3, "semantic": 0.25, "length_part": 0.15, "context_part": 0.2, "language_part": 0.1}
THRESHOLDS = {"confidence": 0.4, "semantic": 0.5, "final": 0.45}


def semantic_score(text: Column, bonus: Column) -> Column:
    count = F.size(F.split(F.trim(text), " +"))
    score = 0.5 + bonus
    for test, loss in ((text.rlike("^[a-z]{1,3}$"), 0.4), (text.rlike("(?i)( and| of| the| with| for)$"), 0.3), (text.rlike("^[^A-Za-z]*$"), 0.4), (count > 8, 0.2)):
        score = score - F.when(test, loss).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def context_score(text: Column, context: Column, indicators: list[str]) -> Column:
    hits = sum((F.when(F.contains(F.lower(context), F.lit(i)), 1).otherwise(0) for i in indicators), F.lit(0))
    inside = F.when(F.contains(F.lower(context), F.lower(text)), 0.2).otherwise(0.0)
    return F.when(context.isNull() | (context == ""), 0.6).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * hits + inside))


def assessed(rows: DataFrame, text: str, confidence: str, bonus: Column, context: str, indicators: list[str], thresholds: dict | None = None) -> DataFrame:
    """Part scores, final score, passed, and the first threshold that failed."""
    t = thresholds or THRESHOLDS
    out = rows.withColumns(
        {
            "semantic": F.round(semantic_score(F.col(text), bonus), 6),
            "length_part": length_score(F.col(text)),
            "context_part": F.round(context_score(F.col(text), F.col(context), indicators), 6),
            "language_part": F.when(F.col(text).rlike("[®™©]"), 1.0).otherwise(0.9),
        }
    )
    parts = {"confidence": F.col(confidence)} | {k: F.col(k) for k in ("semantic", "length_part", "context_part", "language_part")}
    out = out.withColumn("final", F.round(sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0)), 6))
    reason = F.when(F.col(confidence) < t["confidence"], "low_confidence").when(F.col("semantic") < t["semantic"], "low_semantic").when(F.col("final") < t["final"], "low_final")
    return out.withColumn("rejection_reason", reason).withColumn("passed", F.col("rejection_reason").isNull())


def summary(assessed_rows: DataFrame) -> DataFrame:
    return assessed_rows.agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
        F.round(F.avg("final"), 6).alias("avg_final"),
        F.round(1 - F.avg(F.col("passed").cast("int")), 6).alias("noise_reduction"),
    )
