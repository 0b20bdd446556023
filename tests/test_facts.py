"""Normal spellings, specifications, food facts and answer contexts on stated inputs."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import normalize as N
from textloom.operators import answers, specs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("PRODUCT", " green_leaf ®  feed ", "GREEN LEAFFEED"),
        ("PRODUCT", "green-leaf feed mix plus", "Green Leaf Feed Mix Plus"),
        ("PRODUCT", "NPK 20-20-20", "Npk 20 20 20"),
        ("PRODUCT", "o'neil feed", "O'Neil Feed"),
        ("CHEMICAL_COMPOUND", "Muriate  of potash", "potassium chloride"),
        ("CHEMICAL_COMPOUND", "water 7732-18-5 pure", "cas: 7732-18-5"),
        ("CHEMICAL_COMPOUND", "H₂SO₄", "h2so4"),
        ("SPECIFICATION", "ph : 6.5, 25 percent, 3 L/hectare", "pH 6.5, 25%, 3 L/ha"),
        ("CROP", "Corn", "maize"),
        ("CROP", "wild Z. mays", "wild zea mays"),
        ("NUTRIENT", "Total Phosphorous", "p"),
        ("NUTRIENT", " Selenium ", "selenium"),
        ("SAFETY_HAZARD", "ghs 7, h 301", "GHS07, H301"),
        ("OTHER", "  a   b.;", "a b"),
        ("OTHER", "", ""),
        (None, "x ,", "x "),
    ],
)
def test_normalized(spark, kind, text, want):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    got = df.select(N.normalized(F.col("t"), F.col("k")).alias("x")).first()["x"]
    assert got == want


def test_normalized_null(spark):
    df = spark.createDataFrame([(None, "CROP"), (None, None)], "t string, k string")
    assert [r[0] for r in df.select(N.normalized(F.col("t"), F.col("k"))).collect()] == [None, None]


def test_specifications(spark):
    text = "pH: 6.5 (20 g/l). Bulk density: 0.5-0.7 g/ml. Heavy metals: 10 ppm max. Salmonella: Absent"
    rows = {r["kind"]: r for r in specs.specifications(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text").collect()}
    assert set(rows) == {"ph_specification", "density_specification", "impurity_specification", "microbial_specification"}
    assert (rows["ph_specification"]["value"], rows["ph_specification"]["qualifier"]) == ("6.5", "20 g/l")
    assert rows["ph_specification"]["confidence"] == 0.85 and rows["ph_specification"]["category"] == "chemical_property"
    density = rows["density_specification"]
    assert (density["value"], density["range_end"], density["unit"], density["category"]) == ("0.5", "0.7", "g/ml", "physical_property")
    assert rows["microbial_specification"]["value"] == "Absent"
    assert rows["impurity_specification"]["qualifier"] == "max" and rows["impurity_specification"]["category"] == "impurity_property"


def test_food_facts(spark):
    text = "Vitamin C: 60 mg, calcium 12.5 mg, 250 kcal/100g. May contain nuts, soy. Gluten-free, E 330, INS 440, GRAS status, kosher certified. Keep in a dry place."
    n, a, r, s = (one(spark, f(F.lit(text))) for f in (specs.nutrition, specs.allergens, specs.food_regulation, specs.storage_conditions))
    assert [tuple(v) for v in n["vitamins"]] == [("C", 60.0, "mg")] and [tuple(v) for v in n["minerals"]] == [("calcium", 12.5, "mg")]
    assert tuple(n["energy"]) == (250.0, "kcal")
    assert a["contains"] == [] and a["may_contain"] == ["nuts", "soy"] and a["free_from"] == ["Gluten"]
    assert r["gras"] and not r["fda_approved"] and r["e_numbers"] == ["E330"] and r["ins_numbers"] == ["INS440"] and r["certifications"] == ["kosher"]
    assert s == ["dry storage"]
    assert one(spark, specs.nutrition(F.lit("")))["energy"] is None


def test_contexts(spark):
    rows = [(1, i, f"f{i}", i if i else None, "x" * 600 if i == 1 else f"t{i}") for i in range(5)] + [(2, 0, None, None, None)]
    df = spark.createDataFrame(rows, "q int, rank int, file string, page int, text string")
    got = {r["q"]: r for r in answers.contexts(df, "q", [F.asc("rank")], "file", "page", "text").collect()}
    assert got[1]["context"] == "[Document: f0, Page: Unknown]\nt0\n\n[Document: f1, Page: 1]\n" + "x" * 500 + "...\n\n[Document: f2, Page: 2]\nt2"
    assert got[1]["sources"] == "**Sources:** f0 (Page Unknown), f1 (Page 1), f2 (Page 2)" and got[1]["pieces"] == 3
    assert got[2]["context"] == "[Document: Unknown, Page: Unknown]\n"


def test_confidences(spark):
    assert one(spark, answers.technical_confidence(F.lit("x" * 101), F.lit(True))) == 0.95
    assert one(spark, answers.technical_confidence(F.lit("x"), F.lit(False))) == 0.5
    assert [one(spark, answers.combined_confidence(F.lit(a), F.lit(b))) for a, b in ((True, True), (True, False), (False, False))] == [0.9, 0.6, 0.3]
    assert tuple(one(spark, answers.first_answer((F.lit(""), 0.9, "a"), (F.lit("yes"), 0.4, "b")))) == ("yes", 0.4, "b")
