"""Greedy clusters against the sequential rule, and the bound that the join rests on."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import clusters


def plain(rows, least=0.85):
    best, mentions = {}, Counter()
    for block, value, c in rows:
        if value is not None:
            old = best.get((block, value))
            best[block, value] = c if old is None else max(old, c if c is not None else old)
            mentions[block, value] += 1
    leaders, out = {}, {}
    for block, value in sorted(best, key=lambda k: (best[k] is None, -(best[k] or 0), k[1])):
        known = leaders.setdefault(block, [])
        near = next((x for x in known if difflib.SequenceMatcher(None, value.lower(), x.lower()).ratio() > least), None)
        if near is None:
            known.append(value)
        out.setdefault((block, near or value), []).append(value)
    return {(b, lead): (len(v), sum(mentions[b, x] for x in v), sorted(v)) for (b, lead), v in out.items()}


def changed(rng, name):
    name = list(name)
    for _ in range(rng.randint(0, 1 + len(name) // 8)):
        at = rng.randrange(len(name) + 1)
        name[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", " ", "X"])
    return "".join(name)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcde fgh", k=rng.choice([1, 2, 3, 4, 5, 7, 12, 20, 40, 230]))) for _ in range(40)]
    return [(rng.choice(["x", "y", None]), changed(rng, rng.choice(stems)), rng.choice([None, 0.5, 0.7, 0.9, 1.0])) for _ in range(700)] + [("x", None, 1.0), ("x", "", 0.1), ("x", "", 0.2), ("y", "aaaa", 1.0), ("y", "AAAA", 0.9)]


@pytest.mark.parametrize("least", [0.85, 0.8, 0.95])
def test_against_sequential_rule(spark, rows, least):
    df = spark.createDataFrame(rows, "kind string, v string, c double").withColumn("name", F.lit(1))
    got = {(r["block"], r["leader"]): (r["size"], r["mentions"], r["members"]) for r in clusters.similarity_clusters(df, F.col("kind"), "v", "c", least).collect()}
    assert got == plain(rows, least) and len(got) > 30


def test_candidates_hold_every_near_pair(spark, rows):
    names = sorted({v.lower() for _, v, _ in rows if v})
    df = spark.createDataFrame([("=", n, i) for i, n in enumerate(names)], "block string, name string, place int")
    met = {(r["a"], r["b"]) for r in clusters.candidates(df, 0.85).collect()}
    near = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if difflib.SequenceMatcher(None, b, a).ratio() > 0.85}
    assert near and near <= met and len(met) < len(names) ** 2 / 4


def test_chain_and_empty(spark):
    """A chain of near names is decided in order, over several rounds."""
    pairs = [("", f"n{i:03}", f"n{i + 1:03}") for i in range(25)]
    got = sorted(r["name"] for r in clusters.first_free(spark.createDataFrame(pairs, "block string, a string, b string")).collect())
    assert got == [f"n{i:03}" for i in range(0, 26, 2)]
    empty = spark.createDataFrame([], "kind string, v string, c double")
    assert clusters.similarity_clusters(empty, F.col("kind"), "v", "c").count() == 0
    with pytest.raises(ValueError):
        clusters.similarity_clusters(empty, F.col("kind"), "v", "c", 0.5)
