"""Parquet tables of a data folder, and lookups on them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df dealt out over a task for about so many rows: costly work on a file that can't be split is then no single task's."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), *df.columns)


def matching(params: dict) -> Column:
    """A predicate from a dict: lists mean membership, other values equality; None means no filter."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in params.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def text_match(columns: list[str], term: str) -> Column:
    """Case-insensitive containment in any column; % and _ are ordinary characters."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration file as a one-row table."""
    return spark.read.option("multiLine", True).json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files with the SHA-256 of their bytes and their size in MB."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "modificationTime", "length", F.sha2("content", 256).alias("file_hash"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), "content")


def sql_rows(spark: SparkSession, folder: str, statement: str, args: dict | None = None) -> DataFrame:
    """Rows of a statement that names tables in braces and parameters by colons; values are bound, never pasted in."""
    import string

    names = {name for _, name, _, _ in string.Formatter().parse(statement) if name}
    return spark.sql(statement, args=args, **{n: load(spark, folder, n) for n in names})


def present(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, present): whether each table can be read; looked up in the file system, no row is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")
    return spark.createDataFrame([(n, at(n).getFileSystem(conf).exists(at(n))) for n in names], "name string, present boolean")
