"""Scores and verdicts of entities against the patterns as Python reads them."""

import collections
import re
import time

from oracle import compare
from pyspark.sql import functions as F
from test_language import plain_score, plain_validity
from textloom.operators import entity_quality as Q
from textloom.plans import entity_quality as plans
from textloom.plans import registry


def plain_semantic(value, kind):
    low, score = value.lower().strip(), 0.5
    bonus, patterns = Q.MEANINGFUL.get(kind.upper(), (0, []))
    score += bonus * any(re.match(p, value, re.I) for p in patterns)
    for name, (loss, patterns) in Q.NOISE.items():
        match = re.match if name in ("incomplete_specifications", "generic_terms") else re.search
        score -= loss * any(match(p, low) for p in patterns)
    score -= 0.3 * (kind.upper() == "CHEMICAL_COMPOUND" and plain_validity(value) < 0.3) + 0.2 * (len(value.split()) > 8) + 0.2 * (value.count(" ") > 6)
    score -= 0.3 * sum(bool(re.search(p, low)) for p in Q.OPEN_ENDS)
    return round(max(0.0, min(1.0, score)), 6)


def plain_length(value):
    words, n = len(value.split()), len(value.strip())
    return 0.0 if not value else 0.1 if n < 2 else 0.3 if words > 6 else 1.0 if 3 <= n <= 30 and words <= 4 else 0.8 if n <= 50 else 0.6


def plain_context(value, context, kind):
    if not context:
        return 0.6
    low = context.lower()
    score = 0.5 + 0.1 * sum(w in low for w in Q.INDICATORS.get((kind or "").lower(), [])) + 0.2 * (value.lower() in low) - 0.3 * any(w in low for w in Q.FURNITURE)
    return round(max(0.0, min(1.0, score)), 6)


def plain_compound(value):
    return next((p for p in Q.COMPOUNDS if re.search(p, value)), None)


def test_scores(spark, folder):
    assert compare(registry.queries()["entity_scores"](spark, folder), registry.oracle_sql()["entity_scores"], folder) is None
    got = {r["id"]: r for r in registry.queries()["entity_scores"](spark, folder).where("id < 0").collect()}
    for key, value, kind, _, context, document_type in plans.STATED:
        v, r = value or "", got[key]
        assert (r["semantic_score"], r["length_score"], r["context_score"], r["compound_pattern"]) == (plain_semantic(v, kind), plain_length(v), plain_context(v, context, document_type), plain_compound(v)), (v, kind)
    # Each pattern list decides some stated value, and most compounds are met first.
    assert len({r["semantic_score"] for r in got.values()}) >= 9 and len({r["compound_pattern"] for r in got.values()}) >= 18


def test_verdicts(spark, folder):
    rows = registry.queries()["entity_verdicts"](spark, folder).collect()
    counted = collections.Counter()
    for r in rows:
        v = r["v"] or ""
        parts = [r["confidence_score"], plain_semantic(v, r["kind"] or ""), plain_length(v), plain_context(v, r["context"], r["document_type"]), plain_score(v, "english" if r["id"] % 2 == 0 else "french")]
        assert parts[1:] == [r["semantic_score"], r["length_score"], r["context_score"], r["language_score"]], v
        assert not r["confidence"] or r["confidence_score"] == min(1.0, r["confidence"])
        final = round(sum(w * p for w, p in zip((0.3, 0.25, 0.15, 0.2, 0.1), parts)), 6)
        assert abs(final - r["final_score"]) < 2e-6
        name, score, least = next((x for x in (("confidence", parts[0], 0.4), ("semantic score", parts[1], 0.5), ("final score", r["final_score"], 0.45)) if x[1] < x[2]), (None, 0, 0))
        assert r["rejection_reason"] == (f"Low {name}: {score:.2f} < {least}" if name else None) and r["passed"] == (name is None)
        assert r["compound_pattern"] == (plain_compound(v) if name is None else None)
        counted[r["kind"], name and name.split()[0]] += 1
    found = {(r["kind"], r["failing"]): r["n"] for r in registry.queries()["verdict_counts"](spark, folder).collect()}
    assert found == dict(counted)
    assert {k[1] for k in found} >= {None, "confidence", "semantic"}


def test_edges(spark):
    """Nulls, empty tables and values of a hundred thousand characters."""
    schema = "v string, k string, c double, x string"
    run = lambda rows: Q.assessed(spark.createDataFrame(rows, schema), "v", "k", "c", "x", F.lit(None).cast("string"), F.lit("english"))
    assert run([]).count() == 0 and Q.rejections(run([])).count() == 0
    r = run([(None, None, None, None)]).first()
    assert (r["confidence_score"], r["semantic_score"], r["length_score"], r["context_score"], r["passed"]) == (0.1, 0.5, 0.0, 0.6, False)
    long = ["A" * 100_000, "Ab " * 40_000, "a-" * 50_000 + "!", "Ab1 " * 30_000 + "is", " " * 100_000 + "x", "a" * 100_000 + "!", "x" + " " * 100_000 + "x"]
    began = time.time()
    got = run([(v, k, 0.9, v) for v in long for k in plans.KINDS]).collect()
    assert len(got) == 35 and time.time() - began < 60
