"""Language model scores, the filter audit and phrase mining against brute force, and their edge cases."""

import math
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import collocations, filter_audit, hidden_markov, html_extract, lm_score

SPACES = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash with those used inside."""
    rows = [(1, "", "en"), (2, None, None), (None, "lost words here", "de"), (3, "same text " * 30, "en"), (3, "same text " * 30, "en"), (4, "same text " * 30, "fr"), (5, "ab" * 60_000, ""), (6, "é ß 日本 🙂 \x00 OK\x1cok # A", "en"), (7, "Tie tie TIE. " * 40, None), (None, "lost words here", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit("x").alias("part"), F.lit(1).alias("words"), F.lit(2).alias("n"), F.lit(3).alias("TEXT"), F.lit(4).alias("row"), F.lit(5).alias("fails"))


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    names = {"en": ["alpha", "beta", "gamma", "delta", "of", "the"], "de": ["eins", "zwei", "drei", "vier", "und", "der"]}
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "de", None])
        words = names[lang or "en"] + [f"w{rng.randint(0, 60)}" for _ in range(4)]
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ".\n", "\t"]) for _ in range(rng.randint(0, 120)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


# language model


def plain_likelihood(model, symbols):
    """Every path of states, one by one."""
    states, total = range(len(model.first)), 0.0
    paths = [((s,), model.first[s] * model.emits[symbols[0], s]) for s in states]
    for x in symbols[1:]:
        paths = [((*p, s), v * model.moves[p[-1], s] * model.emits[x, s]) for p, v in paths for s in states]
    total = sum(v for _, v in paths)
    return math.log(total)


def test_forward_sums_all_paths():
    rng = np.random.default_rng(1)
    model = hidden_markov.start(np.full(5, 0.2), 3, 0.6)
    texts = [rng.integers(0, 5, n) for n in (1, 4, 7, 4, 2)]
    assert np.allclose(hidden_markov.log_likelihoods(model, texts), [plain_likelihood(model, t) for t in texts])
    long = [rng.integers(0, 5, 5000)]
    assert np.isfinite(hidden_markov.log_likelihoods(model, long)).all()


def test_chances_sum_to_one():
    """Over all sequences of a length the likelihoods sum to one."""
    model = hidden_markov.start(np.array([0.5, 0.3, 0.2]), 4, 0.7)
    every = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    assert abs(np.exp(hidden_markov.log_likelihoods(model, every)).sum() - 1) < 1e-9


def test_expected_counts():
    """Counts of a pass equal those over all paths, however the sequences are grouped."""
    rng = np.random.default_rng(2)
    model = hidden_markov.start(np.full(4, 0.25), 2, 0.8)
    texts = [rng.integers(0, 4, n) for n in (5, 3, 1, 6)]
    moves, emits = np.zeros((2, 2)), np.zeros((2, 4))
    for t in texts:
        paths = [((s,), model.first[s] * model.emits[t[0], s]) for s in range(2)]
        for x in t[1:]:
            paths = [((*p, s), v * model.moves[p[-1], s] * model.emits[x, s]) for p, v in paths for s in range(2)]
        total = sum(v for _, v in paths)
        for p, v in paths:
            for a, b in zip(p, p[1:]):
                moves[a, b] += v / total
            for s, x in zip(p, t):
                emits[s, x] += v / total
    for group in (1, 4, 100):
        counts = hidden_markov.Counts(4, 2)
        for g in hidden_markov.blocks(iter(texts), most=8, group=group):
            counts.add(model, g)
        assert np.allclose(counts.moves, moves) and np.allclose(counts.emits, emits) and abs(counts.first.sum() - 4) < 1e-9


def test_training_raises_likelihood():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 5, 40) + 5 * (k % 2) for k in range(40)]  # two kinds of texts
    unigram = np.full(10, 0.1)
    model, said = hidden_markov.start(unigram, 2, 0.98), []
    for _ in range(6):
        counts = hidden_markov.Counts(10, 2)
        counts.add(model, texts)
        said.append(hidden_markov.log_likelihoods(model, texts).sum())
        model = hidden_markov.step(counts, unigram)
    assert all(b > a - 1e-6 for a, b in zip(said, said[1:])) and said[-1] > said[0] + 500


def base_scores(rows):
    texts = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in texts if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((i is None, i or 0, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in texts)


def told(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


@pytest.mark.parametrize("lookup", [1_000_000, 20])
def test_lm_base(spark, prose, lookup):
    """Base sums are exact, whether seldom words are few or nearly all; held-out texts score above them."""
    df, rows = prose
    got = lm_score.score(df, states=4, passes=4, lookup=lookup).persist()
    assert told(got) == base_scores([r[:2] for r in rows])
    held = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"] and got.where("score > 0 OR isnan(score)").count() == 0


def test_lm_odd(spark, odd):
    got = lm_score.score(odd, states=2, passes=2).persist()
    assert told(got) == base_scores([tuple(r)[:2] for r in odd.collect()])
    assert {round(r["score"], 9) for r in got.where("doc_id = 3").collect()}.__len__() == 1
    assert lm_score.score(odd.limit(0)).count() == 0
    out = odd.where(lm_score.held_out(F.col("doc_id")))
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in lm_score.score(out.union(out), states=2, passes=1).collect())


def test_lm_real(spark, folder):
    """On the given documents the trained model beats the base score on held-out texts by a third of a digit a token."""
    r = lm_score.score(spark.read.parquet(f"{folder}/documents.parquet")).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
    assert r["s"] > r["b"] + 0.3


def test_lookup():
    words = [b"a%d" % i for i in range(500)]
    found = lm_score.Lookup(words, np.arange(1, 501))
    assert found.find([b"a7", b"none", b"a499"]).tolist() == [8, 0, 500] and lm_score.Lookup([], np.zeros(0)).find([b"a"]).tolist() == [0]


# filter audit


def plain_audit(rows, marks):
    def words(t):
        for c in SPACES:
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    flags = []
    for i, text, lang in rows:
        t = text or ""
        w = words(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = dict(zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copy)))
        flags.append((lang or "", fails, *marks.get(i, (False, False))))
    out = {}
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for k, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[x] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(f[1][x] for f in own) - len(gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_audit_odd(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (4, 0, None), (None, 1, 1), (6, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(odd, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    rows = [tuple(r)[:3] for r in odd.collect()]
    assert got == plain_audit(rows, {3: (True, True), 4: (False, False), 6: (True, True)})
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    assert filter_audit.audit(odd, labels.limit(0)).count() == 4 * 600


def test_audit_other_filters(spark):
    """The replay takes any few filters."""
    rows = spark.createDataFrame([("p", [True, False], True, False, 5), ("p", [True, True], False, False, 2)], "part string, fails array<boolean>, good boolean, toxic boolean, n long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.replay(rows, "XY").collect()}
    assert got == {("XY", 1): (0, 7, 0, 12), ("XY", 2): (0, 0, 2, 2), ("YX", 1): (5, 2, 0, 2), ("YX", 2): (0, 5, 2, 12)}


# phrases


def plain_phrases(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang, t = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(c, ".")
        for piece in t.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    key = lang, tuple(w[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = []
    for lang in totals:
        found = []
        for (of, p), a in often.items():
            if of == lang:
                if any(o == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in often.items()):
                    continue
                score, _, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases(spark, prose, monkeypatch):
    df, rows = prose
    fields = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(df).columns == fields
    for least, top in ((30, 2000), (5, 7)):
        want = plain_phrases(rows, least, top)
        assert len(want) > 20 and sorted(map(tuple, collocations.collocations(df, least, top=top).collect())) == want
    monkeypatch.setattr(collocations, "BLOCK", 500)  # many blocks, each with its own candidates
    assert sorted(map(tuple, collocations.collocations(df, 30).collect())) == plain_phrases(rows, 30, 2000)


def test_phrases_any_sketch(spark, prose):
    """A sketch too small to tell phrases apart gives the same counts."""
    df, _ = prose
    wide, narrow = (sorted(map(tuple, collocations.phrase_counts(df, 20, most_bits=b).collect())) for b in (29, 16))
    assert wide == narrow
    marks = np.full(1 << 13, 255, np.uint8)  # all bounds reached
    block = collocations.Block("en")
    block.add("a b. a b c")
    assert sorted(collocations.candidates(block, 16, marks)) == ["a", "a b", "a b c", "b", "b c", "c"]
    assert collocations.scan(block.texts, ["a b", "b", "b c", "a c"]).tolist() == [2, 2, 1, 0]


def test_phrases_odd(spark, odd):
    rows = [tuple(r)[:3] for r in odd.collect()]
    got = sorted(map(tuple, collocations.collocations(odd).collect()))
    assert got == plain_phrases(rows, 30, 2000) and {r[0] for r in got} >= {"en", "und"}
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, l, r = 9_000_000_000_000_000, 9_100_000_000_000_001, 9_200_000_000_000_003
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(F.expr(collocations.SCORE)).first()[0]
    assert got == 2_000_000 * a // (l + r)


# pages that are cut off


def test_cut_pages_in_time(folder):
    """Every page of a table cut at each of its positions near tags, and open tags of 100 kB, are read in linear time."""
    import time

    import pyarrow.parquet as pq

    began = time.time()
    for source in pq.read_table(f"{folder}/pages.parquet", columns=["html"])["html"].to_pylist()[:4]:
        for at in range(len(source or "")):
            html_extract.Page(source[:at]).main_text()
    assert time.time() - began < 120
    opens = ["<a " * 33_000, '<img alt="' + "x" * 100_000, "<img " + "x" * 100_000, "<p " + "a=" * 50_000, "<p " + "a=' " * 25_000, "<p \"'" * 20_000, '<a b="' * 16_000, "<!" * 50_000, "<" * 100_000, "</" * 50_000, "<script " * 12_000, "<a href=\"x' " * 8_000]
    for tail in opens:
        began = time.time()
        assert html_extract.Page("<article><p>Some text</p>" + tail).main_text().startswith("Some text")
        assert time.time() - began < 5, tail[:20]


def test_open_quote_ends_tag():
    assert html_extract.Page('<p>a</p><a href="x>b</a><p>c</p>').main_text() == "a b c"
