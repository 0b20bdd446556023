"""Questions: intents, mentions, candidates, scores and expansion on stated inputs and against plain Python."""

import difflib

import pytest
from pyspark.sql import functions as F

from textloom.operators import enhance


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("the crop and soil of a field", "agricultural"), ("kosher food additive", "food_industry"), ("contract clause on liability", "legal"), ("natural quality", "mixed"), ("crop food", "mixed"), ("", "agricultural")],
)
def test_domain(spark, text, want):
    assert one(spark, enhance.rule_domain(F.lit(text))) == want


def test_intents(spark):
    texts = ["How to apply it", "nothing", "", None, "compare safety", "how to use this: compare"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["intent"], r["intent_score"]) for r in enhance.with_intents(rows, "text").collect()}
    assert got[0] == ("application_instructions", round(12 / 15, 6))
    assert got[1] == got[2] == got[3] == ("general", 0.0)
    assert got[4] == ("comparison", 0.5)
    assert got[5][0] == "application_instructions"


def test_mentions(spark):
    found = enhance.mentions_in("use red widget with 5 kg", "agricultural", {"PRODUCT": ["Red Widget"]})
    assert [(m[2], m[3]) for m in found] == [("Red Widget", "known_entity"), ("5", "measurement")]
    assert enhance.mentions_in("", "legal", {}) == []
    rows = spark.createDataFrame([(1, "gluten and E 330", "food_industry"), (2, None, "legal")], "id int, text string, domain string")
    got = enhance.mentions(rows, "id", "text", "domain").collect()
    assert [(r["id"], r["value"], r["kind"]) for r in got] == [(1, "gluten", "allergen"), (1, "330", "e_number")]


def test_candidates_against_plain_python(spark):
    names = ["Red Widget", "red ring", "blue bolt", "old RED bolt", "ab", "rédaction"]
    entities = spark.createDataFrame([(n, i % 3) for i, n in enumerate(names)], "value string, confidence int")
    asked = {1: ["red", "bolt"], 2: ["zzz"], 3: ["ab"], 4: ["BOLT", "bolt"], 5: []}
    questions = spark.createDataFrame(list(asked.items()), "id int, terms array<string>")
    got = enhance.candidates(questions, "id", "terms", entities, "value", [F.desc("confidence"), F.asc("value")], per_term=2, most=3)
    want = set()
    for key, terms in asked.items():
        listed = []
        for t in terms:
            if len(t) > 2:
                hit = sorted((-(i % 3), n) for i, n in enumerate(names) if t.lower() in n.lower())[:2]
                listed += [n for _, n in hit if n not in listed]
        want |= {(key, n, i + 1) for i, n in enumerate(listed[:3])}
    assert {(r["id"], r["value"], r["place"]) for r in got.collect()} == want


def test_match_scores_against_plain_python(spark):
    rows = [
        ("what is red widget product", "product_information", "red widget", "PRODUCT", "the red product", 1.0),
        ("what is it", "general", "it might", "CROP", None, 0.5),
        ("abcdefgh", "comparison", "abcdxfgh", "METRIC", "", 0.1),
        ("zz", "general", "qqqq", "CROP", "", 0.0),
    ]
    df = spark.createDataFrame(rows, "q string, intent string, value string, kind string, context string, share double")
    got = {r["value"]: r for r in enhance.match_scores(df, "q", "intent", "value", "kind", "context", "share").collect()}
    assert set(got) == {"red widget", "it might", "abcdxfgh"}
    ratio = difflib.SequenceMatcher(None, "abcdefgh", "abcdxfgh").ratio()
    assert got["abcdxfgh"]["score"] == round(0.3 * 0.9 + 0.4 * ratio + 0.05 * 0.1, 6)
    assert got["red widget"]["score"] == round(0.3 + 0.4 + 0.15 * (2 / 5 + 0.5) + 0.1 * 2 / 5 + 0.05, 6)
    assert got["it might"]["score"] == round(0.3 * 0.3 + 0.4 * 0.7 + 0.15 * 1 / 4 + 0.05 * 0.5, 6)
    assert got["red widget"]["reason"].startswith("exact text match; highly relevant")


def test_enhancement(spark):
    df = spark.createDataFrame([("q", [(0.9, "nitrogen", "PRODUCT"), (0.65, "corn", "CROP"), (0.2, "x", "PRODUCT")]), ("none", [])], "q string, matches array<struct<score:double,value:string,kind:string>>")
    m = F.col("matches")
    rows = {r["q"]: r for r in df.select("q", enhance.enhanced_text(F.col("q"), m).alias("t"), enhance.enhancement_confidence(m).alias("c"), enhance.expansion_terms(F.lit("agricultural"), F.lit("comparison"), m).alias("e")).collect()}
    assert rows["q"]["t"] == "q | product information for nitrogen | crop-specific information for corn"
    assert rows["q"]["c"] == round(0.45 + 0.195 + 0.04 + 0.2, 6)
    assert rows["none"]["t"] == "none" and rows["none"]["c"] == 0.0
    assert rows["none"]["e"] == sorted(["compare", "alternative", "versus", "similar", "field", "farm", "crop protection", "yield"])
    assert len(rows["q"]["e"]) == 10 and rows["q"]["e"] == sorted(rows["q"]["e"])
    f = df.select("q", enhance.suggested_filters(F.lit("legal"), m, F.transform(m, lambda x: x["score"])).alias("f")).collect()
    assert f[0]["f"]["threshold"] == round((0.9 + 0.65 + 0.2) / 3 - 0.2, 6) and f[1]["f"]["threshold"] == 0.5
    assert f[0]["f"]["entity_types"] == ["CROP", "PRODUCT"]
