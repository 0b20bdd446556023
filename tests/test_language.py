"""Languages and chemical validity against the patterns as Python reads them."""

import re

import pytest
from oracle import compare
from textloom.operators import entity_language as L
from textloom.plans import language, registry


def plain_evidence(value):
    low = value.lower()
    out = {k: 2 * (low in L.WORDS[k]) + sum(bool(re.search(p, low)) for p in L.PATTERNS[k]) + 3 * sum(bool(re.search(p, low)) for p in L.PHRASES[k]) for k in L.WORDS}
    out["french"] += 2 * sum(bool(re.search(p, value, re.I)) for p in L.FRENCH_MARKS)
    return out


def plain_score(value, expected):
    low = value.lower()
    if expected == "french" and any(re.search(p, low) for p in L.PHRASES["french"]):
        return 0.1
    wrong = "french" if expected == "english" else "english"
    if low in L.WORDS[wrong]:
        return 0.2
    if any(re.search(p, low) for p in L.PHRASES[wrong]):
        return 0.1
    if any(re.search(p, low) for p in L.PATTERNS[wrong]):
        return 0.3
    return 1.0 if any(re.search(p, value) for p in L.TRADEMARKS) else 0.9


def plain_validity(value):
    low, score = value.lower().strip(), 0.5
    score += 0.3 * any(re.match(p, value, re.I) for p in L.VALID_NAMES) - 0.4 * any(re.search(p, low) for p in L.INVALID_NAMES) + 0.1 * (len(value.split()) <= 4)
    score += 0.2 * any(w in low for w in L.FOR) + 0.2 * ("®" in value or "™" in value) + 0.1 * bool(re.search("^[A-Z]", value)) - 0.3 * any(w in low for w in L.AGAINST)
    return round(max(0.0, min(1.0, score)), 6)


@pytest.mark.parametrize("name", ["sample_language", "language_scores", "chemical_validity"])
def test_against_sql(spark, folder, name):
    assert compare(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder) is None


def test_samples(spark, folder):
    got = {r["k"]: (r["english"], r["french"], r["language"]) for r in registry.queries()["sample_language"](spark, folder).collect()}
    for k, _, v in language.STATED[: len(language.VALUES)]:
        e = plain_evidence(v or "")
        assert got[k] == (e["english"], e["french"], "french" if e["french"] >= 2 and e["french"] > e["english"] else "english"), v
    assert got["long"] == (0, 0, "english") and got[None][2] == "french"
    assert {g[2] for g in got.values()} == {"english", "french"}


def test_scores_and_validity(spark, folder):
    scores = {r["v"]: (r["as_english"], r["as_french"], r["as_other"]) for r in registry.queries()["language_scores"](spark, folder).collect()}
    validity = {r["v"]: r["validity"] for r in registry.queries()["chemical_validity"](spark, folder).collect()}
    for v in [x or "" for x in language.VALUES]:
        assert scores[v] == (plain_score(v, "english"), plain_score(v, "french"), 0.8), v
        assert validity[v] == plain_validity(v), v
    assert {s for v in scores.values() for s in v} == {0.1, 0.2, 0.3, 0.8, 0.9, 1.0} and len(set(validity.values())) >= 6
