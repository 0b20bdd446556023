"""Costly work on a table of one file is dealt out over tasks that grow with its rows."""

import pytest
from pyspark.sql import functions as F

from textloom.plans import registry
from textloom.sources.tables import dealt


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("ACME® starch 5 kg and NPK 10-5-5. pH: 5.5").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "red ring", "LARGE", 5)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    return at


@pytest.mark.parametrize("name, key", [("entity_scores", "id"), ("entity_verdicts", "id"), ("product_entities", "doc_id"), ("compound_entities", "doc_id")])
def test_one_file_is_dealt_out(spark, one_file, name, key):
    found = registry.queries()[name](spark, one_file).where(F.col(key) >= 10)
    rows = found.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct(key).alias("n")).collect()
    assert len(rows) >= 3 and max(r["n"] for r in rows) < 2000


def test_dealt_keeps_every_row(spark):
    rows = spark.createDataFrame([(None, None)] * 5 + [(1, "a")] * 3 + [(2, None)], "k long, v string")
    assert sorted(map(repr, dealt(rows, 2).collect())) == sorted(map(repr, rows.collect()))
    assert dealt(rows, 2).rdd.getNumPartitions() == 5 and dealt(rows.where("k = 7")).count() == 0
