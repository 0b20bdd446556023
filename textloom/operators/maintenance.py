"""Writes as transformations: upsert, retention, cascade, versions, first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Current rows with changed values in place, and new keys added; of several changes the greatest counts."""
    new = changes.groupBy(key).agg(F.max(value).alias("_new"))
    return current.select(key, value).join(new, key, "full").select(key, F.coalesce("_new", value).alias(value), F.col("_new").isNotNull().alias("changed"))


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def cascade(doomed: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows that remain and go in each child table when the doomed keys are deleted."""
    keys = doomed.select(F.col(key).alias("_x")).distinct()
    parts = []
    for name, (table, column) in children.items():
        gone = table.join(keys, F.col(column) == F.col("_x"), "left").agg(F.count("_x").alias("deleted"), F.count(F.when(F.col("_x").isNull(), 1)).alias("remaining"))
        parts.append(gone.select(F.lit(name).alias("table_name"), "deleted", "remaining"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def first_of(rows: DataFrame, by: list[Column], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def ingest(existing: DataFrame, arriving: DataFrame, project: str, name: str, digest: str) -> DataFrame:
    """Arriving rows whose content the project lacks, with the next versions of their names, in order of the digests.

    Of arriving rows of one content that of the least name is taken.
    """
    one = arriving.groupBy(project, digest).agg(F.min_by(F.struct(*arriving.columns), F.struct(name, *sorted(c for c in arriving.columns if c != name))).alias("_row")).select("_row.*")
    fresh = one.join(existing.select(project, digest).distinct(), [project, digest], "left_anti")
    last = existing.groupBy(project, name).agg(F.max("version").alias("_last"))
    numbered = fresh.join(last, [project, name], "left").withColumn("_n", F.row_number().over(Window.partitionBy(project, name).orderBy(digest)))
    return numbered.withColumn("version", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_last", "_n")
