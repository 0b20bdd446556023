"""Candidates of questions that share frequent terms."""

from pyspark.sql import functions as F

from textloom.operators import enhance


def test_equal_lists_of_terms_are_answered_once(spark):
    """Candidates are ranked for each distinct list of terms, not for each question."""
    rows = spark.range(4000).select("id", F.array(F.lit("Red Ring"), F.lit("red"), F.lit("ring")).alias("terms"))
    names = spark.createDataFrame([(f"red ring {i:02}", i) for i in range(20)], "name string, size int")
    found = enhance.candidates(rows, "id", "terms", names, "name", [F.desc("size"), F.asc("name")])
    assert found.count() == 4000 * 20
    assert "windowspecdefinition(id#" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_empty_questions(spark):
    rows = spark.createDataFrame([(1, ["ring", "red"]), (1, ["bolt"]), (2, []), (3, None), (4, ["xx", "no"]), (None, ["RED"])], "id int, terms array<string>")
    names = spark.createDataFrame([("red ring", 1), ("bolt", 2), ("Red", 3)], "name string, size int")
    found = enhance.candidates(rows, "id", "terms", names, "name", [F.desc("size")])
    assert found.columns == ["id", "name", "size", "place"]
    got = {}
    for r in found.collect():
        got.setdefault(r.id, {})[r.place] = r.name
    assert set(got) == {1, None} and set(got[1].values()) == {"red ring", "bolt", "Red"} and got[1][3] == "Red" and got[None] == {1: "Red", 2: "red ring"}
