"""Configured entities against a search pattern by pattern, and food relations against pairwise containment."""

import re

import pytest

from textloom.operators import configured, entity_config as config
from textloom.plans import configured as plans


def plain_products(text):
    out = []
    for kind, patterns in config.PRODUCT_PATTERNS.items():
        found = []
        for p in patterns:
            for m in re.finditer(p, text, re.I):
                value = m.group().strip()
                if configured.valid(value, kind):
                    context = text[max(0, m.start() - 100) : min(len(text), m.end() + 100)].strip()
                    words = config.PRODUCT_KEYWORDS[kind]
                    score = min(0.3 + (sum(1 for w in words if w.lower() in context.lower()) / len(words)) * 0.7, 1.0)
                    found.append((kind, value, score, m.start(), m.end(), context, *configured.normalized(value, kind)))
        found.sort(key=lambda f: f[3])
        kept = []
        for f in found:
            if not any(f[1].lower() == k[1].lower() or max(0, min(f[4], k[4]) - max(f[3], k[3])) / min(f[4] - f[3], k[4] - k[3]) > 0.5 for k in kept):
                kept.append(f)
        out += sorted(kept, key=lambda f: -f[2])
    return out


def plain_foods(text):
    out = []
    for kind in config.FOOD_PATTERNS:
        spots = [(m.start(), m.end(), m.group().strip(), 150, 0.5) for p in config.FOOD_PATTERNS[kind] for m in re.finditer(p, text, re.I)]
        for e in config.FOOD_EXAMPLES[kind]:
            at = text.lower().find(e.lower())
            while at >= 0:
                end = at + len(e)
                if (at == 0 or not text[at - 1].isalnum()) and (end >= len(text) or not text[end].isalnum()):
                    spots.append((at, end, e, 100, 0.6))
                at = text.lower().find(e.lower(), at + 1)
        for start, end, value, reach, least in spots:
            context = text[max(0, start - reach) : end + reach].strip()
            low, score = context.lower(), 0.5
            score += sum(w in low for w in config.FOOD_INDICATORS.get(kind, [])) * 0.15
            if kind == "FOOD_SAFETY_STANDARD" and any(w in low for w in ["haccp", "gmp", "brc", "sqf", "ifs", "fssc", "gras", "fda approved", "food grade", "kosher", "halal", "organic", "non-gmo"]):
                score += 0.2
            if kind == "NUTRITIONAL_COMPONENT" and re.search(r"\d+\s*(?:mg|g|%|iu)", low):
                score += 0.15
            if kind == "ALLERGEN_INFO" and ("allergen" in low or "contains" in low):
                score += 0.2
            if min(score, 1.0) > least:
                out.append((kind, value, min(score, 1.0), start, end, context))
    return out


def plain_relations(text, entities):
    def match(phrase):
        low = phrase.lower().strip()
        return next((e for e in entities if e[1].lower() in low or low in e[1].lower() or (e[6] and e[6].lower() in low)), None)

    out = []
    for kind, patterns in config.FOOD_RELATIONS.items():
        for p in patterns:
            for m in re.finditer(rf"([^.]+?)\s+{p}\s+([^.]+)", text, re.I):
                a, b = match(m[1].strip()), match(m[2].strip())
                if a and b:
                    low = m[0].lower()
                    score = min(sum(w in low for w in config.RELATION_INDICATORS.get(kind, [])) * 0.25, 0.7)
                    if (a[0], b[0]) in config.RELATION_PAIRS.get(kind, []):
                        score += 0.2
                    if any(w in low for w in ["food", "ingredient", "additive", "preservative"]):
                        score += 0.1
                    if score > 0.5:
                        out.append((kind, a[1], a[0], b[1], b[0], min(score, 1.0), m[0]))
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = plans._rows(spark, folder).collect()
    more = [". ".join(t for _, t in plans.TEXTS if t), "İron and İ iron. K5 kelvin Kcal ſalt", "CONTAINS MILK contains milk-contains milk", "  used in food ingredient added to xanthan gum"]
    return [r["text"] or "" for r in rows if r["doc_id"] < 40] + more


def test_products(texts):
    matcher = configured.Matcher(config.PRODUCT_PATTERNS)
    found = {t: configured.product_entities(t, matcher) for t in texts}
    assert all(found[t] == plain_products(t) for t in texts)
    assert {e[0] for es in found.values() for e in es} == set(config.PRODUCT_PATTERNS)


def test_foods(texts):
    food, product = configured.Matcher(config.FOOD_PATTERNS, config.FOOD_EXAMPLES), configured.Matcher(config.PRODUCT_PATTERNS)
    kinds = set()
    for t in texts:
        found = configured.food_entities(t, food, product)
        want = plain_foods(t) if len(t.lower()) == len(t) else None
        own = [e[:6] for e in found if e[0] in config.FOOD_PATTERNS]
        assert want is None or own == want
        assert [e[:9] for e in found[len(own) :]] == plain_products(t)
        kinds |= {e[0] for e in own}
    assert kinds == {"FOOD_INGREDIENT", "FOOD_ADDITIVE_TYPE", "FOOD_APPLICATION", "FOOD_SAFETY_STANDARD", "NUTRITIONAL_COMPONENT", "ALLERGEN_INFO"}  # the kinds that have indicators


def test_relations(texts):
    food, product = configured.Matcher(config.FOOD_PATTERNS, config.FOOD_EXAMPLES), configured.Matcher(config.PRODUCT_PATTERNS)
    met = set()
    for t in texts:
        entities = configured.food_entities(t, food, product)
        found = configured.relations_of(t, lambda _: entities)
        assert found == plain_relations(t, entities)
        met |= {r[0] for r in found}
    assert met >= {"USED_IN_FOOD", "HAS_FUNCTION", "APPROVED_FOR", "CONTAINS_ALLERGEN", "REPLACES_INGREDIENT", "ENHANCES_PROPERTY"}


def test_food_info():
    info = configured.food_info
    assert info("NUTRITIONAL_COMPONENT", "vitamin C 60 mg")[:2] == (60.0, "mg") and info("NUTRITIONAL_COMPONENT", "vitamin C 60 mg, iron 5 g")[:2] == (5.0, "g")
    assert info("FOOD_SAFETY_STANDARD", "GRAS")[2] == "GRAS approved" and info("FOOD_SAFETY_STANDARD", "GRAS E 330")[2] == "E330"
    assert info("ALLERGEN_INFO", "may contain nuts, soy.")[3:5] == (["nuts", "soy"], None) and info("ALLERGEN_INFO", "contains soy. nut-free")[3:5] == (None, "nut")
    assert info("X", "shelf life: 12 months of food grade")[5:] == ("12 months", True)


def test_anchors():
    """Every match of a pattern holds one of its anchors."""
    assert configured.anchors(r"\b(?:xanthan|guar)\s+gum\b") == ["xanthan", "guar"] and configured.anchors(r"\bH\d{3}\b") == [] and configured.anchors(r"a(?:bcd)?e*fghi?") == ["fgh"]
    for listed in [*config.PRODUCT_PATTERNS.values(), *config.FOOD_PATTERNS.values()]:
        for p in listed:
            for _, t in plans.TEXTS:
                for m in re.finditer(p, t or "", re.I):
                    needs = configured.anchors(p)
                    assert not needs or any(a in configured.lowered(m[0]) for a in needs)


def test_long_texts_in_time():
    """Runs of white space and long sentences are read in linear time."""
    import time

    food, product = configured.Matcher(config.FOOD_PATTERNS, config.FOOD_EXAMPLES), configured.Matcher(config.PRODUCT_PATTERNS)
    for t in (" " * 100_000 + "used in food", "food ingredient " + " " * 100_000 + "then x", "xanthan gum used in dairy products " * 3000, "Milk contains " * 8000):
        began = time.time()
        configured.relations_of(t, lambda t: configured.food_entities(t, food, product))
        assert time.time() - began < 20


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "contains milk allergen"), (None, "contains milk allergen")]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert configured.products(docs, "id", "text").where("id IS NOT NULL").count() == 0
    found = configured.foods(docs, "id", "text").where("kind = 'ALLERGEN_INFO'").collect()
    assert len(found) == 4 and found[0]["contains"] == ["milk allergen"]
    assert configured.food_relations(docs.limit(0), "id", "text").count() == 0
