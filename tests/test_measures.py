"""Named values, farm entities and contract specifications against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import measures, records
from textloom.plans.measures import TEXTS


def test_technical_values(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    held = set()
    for r in df.select("doc_id", *[v.alias(k) for k, v in measures.technical(F.col("text")).items()]).collect():
        text = dict(TEXTS)[r["doc_id"]] or ""
        for kind, p in measures.TECHNICAL.items():
            want = [m[1] for m in re.finditer(p, text)]
            assert r[kind] == want, kind
            held |= {kind} if want else set()
    assert held == set(measures.TECHNICAL)


def test_farm_entities(spark):
    df = spark.createDataFrame([*TEXTS, (1, "Été d'Aiéa Xé eX a é9B")], "doc_id long, text string")
    for r in df.select("text", *[v.alias(k) for k, v in measures.farm_entities(F.col("text")).items()]).collect():
        for kind, (patterns, once) in measures.FARM.items():
            found = [(m[1].strip() if kind == "crops" else m[0]) for p in patterns for m in re.finditer(p, r["text"] or "", re.I)]
            assert r[kind] == (list(dict.fromkeys(found)) if once else found), kind


def test_legal_specifications(spark):
    found = measures.legal_specifications(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", "text").collect()
    by = {(r["doc_id"], r["kind"]): r for r in found}
    assert {k for _, k in by} == set(measures.LEGAL)
    time = by[-6, "time_specification"]
    assert (time["value"], time["unit"], time["qualifier"], time["category"]) == ("30 days", "time period", "within signing", "temporal_terms") and time["confidence"] == 0.7
    money = by[-7, "financial_specification"]
    assert money["value"] == "$1,000,000.50" and money["property"] == "Financial Specification"
    need = by[-6, "requirement_specification"]
    assert need["value"].startswith("shall be kept in force") and need["qualifier"].startswith("within 30 days") and need["confidence"] == pytest.approx(1.0)
    for r in found:
        text = dict(TEXTS)[r["doc_id"]]
        assert any(m.span() == (r["start"], r["end"]) for m in re.finditer(measures.LEGAL[r["kind"]], text, re.I)) and r["context"] in text


def test_identifiers(spark):
    import uuid

    said = ["123e4567-e89b-12d3-a456-426614174000", "123E4567E89B12D3A456426614174000", "{123e4567-e89b-12d3-a456-426614174000}", "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "doc-7", "", None, "123e4567-e89b-12d3-a456-42661417400g"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("x", records.as_uuid(F.col("x")).alias("u"))
    for r in df.collect():
        try:
            want = str(uuid.UUID(r["x"])) if r["x"] is not None else None
        except ValueError:
            want = None
        assert r["u"] == want
