"""Tables that grow with the input are merged, not gathered in the driver to be broadcast."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import components, simhash_dedup, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"a text of some {i % 7} words for number {i % 11} and more", "en", "web") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def gathered(df) -> bool:
    df.collect()
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_simhash_broadcasts_nothing(spark, docs):
    fps = spark.range(200).select(F.xxhash64("id").alias("fp"))
    near = fps.union(fps.select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"))).distinct()
    assert not gathered(simhash_dedup.links(near))
    assert not gathered(simhash_dedup.group(docs))


def test_components_broadcast_nothing(spark):
    edges = spark.range(100).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert not gathered(components._large(edges))
    assert not gathered(components._small(edges))


def test_near_copies_of_pipeline_broadcast_nothing(spark, docs):
    assert not gathered(corpus_pipeline.drop_near_copies(spark, docs, ""))


def test_near_copies_of_pipeline_have_a_short_plan(spark, docs):
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert "MapInArrow" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(kept._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|").split("|")) <= 4


def test_training_holds_one_step_of_bags(spark, monkeypatch):
    """While training runs, the bags are on disk, each as it was made and in the order of ids."""
    rng = random.Random(4)
    texts = {i: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(200)) for i in range(400)}
    seen = {}

    def train(bags, toxic, *rest):
        seen.update(n=len(bags), held=pa.total_allocated_bytes() - before, first=bags[0], last=bags[len(bags) - 1], toxic=toxic.tolist(), size=sum(8 * len(bags[i][0]) for i in range(len(bags))))

    monkeypatch.setattr(toxicity, "train", train)
    before = pa.total_allocated_bytes()
    marked = spark.createDataFrame([(i, i % 3 % 2) for i in texts], "doc_id long, toxic int")
    toxicity.fit(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), marked, buckets=1 << 17)
    ids = sorted(r["doc_id"] for r in marked.where(~toxicity.held_out(F.col("doc_id"))).collect())
    assert seen["n"] == 2 * len(ids) and seen["toxic"] == [i % 3 % 2 for i in ids for _ in "ab"]
    assert seen["held"] < seen["size"] / 10
    for got, text in ((seen["first"], texts[ids[0]]), (seen["last"], toxicity.misspelt(texts[ids[-1]]))):
        assert all((a == b).all() for a, b in zip(got, toxicity.bag(text, 1 << 17)))
