"""Pattern extraction with places, scores and greedy choice."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of general technical values (fixed values).
PATTERNS = {
    "cas_number": r"\b\d{2,7}-\d{2}-\d\b",
    "ph": r"\bpH\s*[:=]?\s*\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?",
    "temperature": r"-?\d+(?:\.\d+)?\s*°\s*[CF]\b",
    "percent": r"\b\d+(?:\.\d+)?\s*%",
    "mass": r"\b\d+(?:\.\d+)?\s*(?:kg|mg|g)(?:/(?:ha|kg|L|ml))?\b",
    "hazard_code": r"\b[HP]\d{3}\b",
    "e_number": r"\bE\s?\d{3,4}[a-z]?\b",
    "iso_standard": r"\bISO\s?\d{3,5}(?:-\d+)?\b",
}
#: Words near a value that speak for it, by pattern (fixed values).
CONTEXT = {
    "ph": ("acid", "alkaline", "range", "solution"),
    "temperature": ("store", "storage", "temperature", "melting", "boiling"),
    "percent": ("composition", "content", "moisture", "purity"),
    "mass": ("rate", "weight", "dose", "apply"),
    "hazard_code": ("hazard", "danger", "warning", "ghs"),
}


def spans_in(text: str, patterns: dict[str, str], reach: int = 100) -> list[tuple]:
    """(kind, start, end, value, context) of every match."""
    return [
        (kind, m.start(), m.end(), m[0], text[max(0, m.start() - reach) : m.end() + reach])
        for kind, pattern in patterns.items()
        for m in re.finditer(pattern, text)
    ]


def spans(docs: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None, reach: int = 100) -> DataFrame:
    """One row per match; each batch of texts is read once for all patterns."""
    patterns = patterns or PATTERNS
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, *s) for k, x in zip(*[c.to_pylist() for c in batch.columns]) for s in spans_in(x or "", patterns, reach)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "kind", "start", "end", "value", "context"])

    any_kind = "|".join(f"(?:{p})" for p in patterns.values())
    return docs.select(key, text).where(F.col(text).rlike(any_kind)).mapInArrow(run, f"{key} {kind}, kind string, start long, end long, value string, context string")


def scored(found: DataFrame, context: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Confidence 0.3 and 0.7 times the share of the kind's context words near the value; 0.5 for kinds without any."""
    score = F.lit(0.5)
    for kind, words in (context or CONTEXT).items():
        near = sum((F.when(F.contains(F.lower("context"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        score = F.when(F.col("kind") == kind, 0.3 + 0.7 * near / len(words)).otherwise(score)
    return found.withColumn("confidence", F.round(score, 6))


def all_matches(text, pattern: str):
    """Distinct matches of a pattern, sorted: native, for patterns without places."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def near_pairs(found: DataFrame, key: str, sources: list[str], targets: list[str], reach: int = 500) -> DataFrame:
    """Relations between spans of allowed kinds that start within reach, scored by distance and confidence."""
    from textloom.operators.relations import band_join

    a = found.where(F.col("kind").isin(sources)).select(key, F.col("start").alias("a"), F.col("value").alias("source_value"), F.col("confidence").alias("ca"))
    b = found.where(F.col("kind").isin(targets)).select(key, F.col("start").alias("b"), F.col("value").alias("target_value"), F.col("confidence").alias("cb"))
    distance = F.abs(F.col("a") - F.col("b"))
    score = 0.3 * F.greatest(F.lit(0.0), (200 - distance) / 200) + 0.1 * (F.col("ca") + F.col("cb")) / 2
    return band_join(a, b, key, "a", "b", reach).where("a <> b").withColumn("distance", distance).withColumn("confidence", F.round(score, 6))
