"""Questions that many rows ask are scored once, and each row has what is found."""

from pyspark.sql import functions as F

from textloom.operators import enhance
from textloom.plans import questions


def test_repeated_questions(spark, tmp_path, monkeypatch):
    names = ["red widget", "small ring", "big red ring", "red widget"]
    rows = [(100 * k + i, n, "LARGE", 10 + i) for k in range(5) for i, n in enumerate(names)]
    spark.createDataFrame([*rows, (900, None, "LARGE", 1)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    scored, was = [], enhance.match_scores
    monkeypatch.setattr(enhance, "match_scores", lambda pairs, *rest: scored.append(pairs.count()) or was(pairs, *rest))
    found = questions.entity_match_scores(spark, str(tmp_path)).collect()
    best = questions.enhanced_questions(spark, str(tmp_path)).collect()
    listed = questions.entity_candidates(spark, str(tmp_path))
    distinct = listed.join(spark.createDataFrame(rows, "p_partkey long, name string, t string, s int").select("p_partkey", "name"), "p_partkey").select("name", "p_name").distinct()
    assert scored == [distinct.count()] * 2
    assert {(r["p_partkey"], r["p_name"]) for r in found} <= {(r["p_partkey"], r["p_name"]) for r in listed.collect()}
    assert len(found) == 5 * len([r for r in found if r["p_partkey"] < 100]) > 0
    assert sorted(r["p_partkey"] for r in best) == sorted(k for k, *_ in rows)
    own = questions._questions(spark, str(tmp_path)).join(listed.withColumnRenamed("p_name", "value"), "p_partkey").join(questions._entities(spark, str(tmp_path)).withColumnRenamed("p_name", "value"), "value")
    plain = was(enhance.with_intents(own, "text").withColumn("context", F.concat_ws(" ", F.lit("corn and"), "value")), "text", "intent", "value", "kind", "context", "share")
    assert {(r["p_partkey"], r["value"], r["score"], r["reason"]) for r in plain.collect()} == {tuple(r) for r in found}
