"""Food and general specifications and compounds against plain Python."""

import random
import re

import pytest

from textloom.operators import chunking, compounds
from textloom.plans.compounds import TEXTS

EVERY = [*compounds.FOOD.items(), *compounds.GENERAL.items(), *(p for ps in compounds.COMPOUNDS.values() for p in ps)]
PIECES = ["Efficacy:", "efficacy: ", "Product ", "increases", " reduces ", "yield", " by ", "5%", "12.5", "-", " - ", " to ", ":", "=", " ", "\n", "kg/ha", " grade ", "type", "A2", "(", ")", "Chemical composition:", "30% ", "x", "Ä", "ſ", ".", "max", "°C", "+", "Application rate: "]


def test_matches_are_those_of_finditer():
    pick = random.Random(3)
    texts = ["".join(pick.choices(PIECES, k=pick.randint(1, 25))) for _ in range(4000)] + [t for _, t in TEXTS if t]
    held = {p: 0 for _, p in EVERY}
    for t in texts:
        for _, p in EVERY:
            want = [m.span() for m in re.finditer(p, t, re.I)]
            assert [m.span() for m in compounds.matches(p, t)] == want, (p, t)
            assert [m.span() for m in compounds.matches(p, t, t.lower())] == want, (p, t)
            held[p] += len(want)
    assert min(held.values()) > 0


def test_long_runs_are_read_once():
    text = "word " * 20_000
    assert not [m for p in compounds.GENERAL.values() for m in compounds.matches(p, text)]
    assert len([m for p in compounds.GENERAL.values() for m in compounds.matches(p, text + ": 5 kg")]) == 1


def test_food_specifications(spark):
    df = spark.createDataFrame([*TEXTS, TEXTS[0]], "text_id long, text string")
    found = [r.asDict() for r in compounds.food_specifications(df, "text_id", "text").collect()]
    assert {r["kind"] for r in found} == set(compounds.FOOD) and not {-12, -13} & {r["text_id"] for r in found}
    fields = ("property", "value", "unit", "qualifier", "category", "has_limit", "has_range", "regulated", "confidence")
    by = {(r["text_id"], r["property"]): tuple(r[f] for f in fields[1:]) for r in found}
    assert by[-1, "Protein"] == ("12.5", "g", "100g", "nutritional_information", False, False, False, 1.0)
    assert by[-1, "Fat"][2] == "per 100g"
    assert by[-1, "Total plate count"] == ("<1000", "CFU/g", "max", "food_safety", True, False, True, 0.95)
    assert by[-1, "pH"] == ("4.2-4.6", "units", "", "quality_parameter", False, True, False, 0.75)
    # The unit's letters take the "f" of "for", so the time after it is never told.
    assert by[-2, "Processing temperature"][:3] == ("72", "°C f", "")
    assert by[-2, "Shelf life"][:2] == ("18", "months") and by[-2, "Storage"][1] == "storage condition"
    assert by[-3, "Ingredients"][1:4] == ("ingredient list", "", "ingredient_information")
    assert by[-3, "Contains"][0] == "milk and traces of nuts" and by[-3, "Contains"][-1] == pytest.approx(0.85)
    assert by[-3, "HACCP"][0] == "" and by[-3, "Non-GMO"][0] == "as certified"
    assert len([r for r in found if r["text_id"] == -1]) == 2 * len({(r["start"], r["kind"]) for r in found if r["text_id"] == -1})
    for r in found:
        assert any(m.span() == (r["start"], r["end"]) for m in re.finditer(compounds.FOOD[r["kind"]], dict(TEXTS)[r["text_id"]], re.I))


def test_general_specifications(spark):
    found = compounds.general_specifications(spark.createDataFrame(TEXTS, "doc_id long, text string"), "doc_id", "text").where("doc_id = -5").collect()
    by = {(r["kind"], r["property"]): (r["value"], r["unit"], r["qualifier"], r["confidence"]) for r in found}
    assert by["general_pattern_0", "Flow rate"] == ("5", "kg/h", "typical", 1.0) and by["general_pattern_0", "Temp"][:2] == ("60", "°C")
    assert by["general_pattern_1", "C and width"][:2] == ("3.5", "mm")
    assert by["general_pattern_2", "range of speed"][:3] == ("10", "20", "rpm")


def test_compound_entities(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for domain, patterns in compounds.COMPOUNDS.items():
        found = compounds.compound_entities(df, "doc_id", "text", domain).collect()
        assert {r["entity_type"] for r in found} == {n for n, _ in patterns}, domain
        for key, text in TEXTS:
            want = [(n, m) for n, p in patterns for m in re.finditer(p, text or "", re.I)]
            got = sorted((r for r in found if r["doc_id"] == key), key=lambda r: int(r["id"].rsplit("_", 1)[1]))
            assert [(r["id"], r["entity_type"], r["value"], r["start"], r["end"]) for r in got] == [(f"compound_{domain}_{i}", n, m[0], *m.span()) for i, (n, m) in enumerate(want)]
            for r, (_, m) in zip(got, want):
                parts = [g for g in m.groups() if g]
                names = [("sub_concept", g.strip(), "component") for g in parts if re.match(r"[A-Za-z\s]", g) and not re.match(r"\d", g)]
                numbers = [("attribute", g, f"value_{i}") for i, g in enumerate(parts) if re.match(r"\d", g)]
                assert [tuple(c) for c in r["components"]] == names + numbers and r["complexity"] == len(parts)
                assert r["has_measurements"] == bool(re.search(r"\d+(?:\.\d+)?\s*[%°C\w/]+", m[0])) and r["has_percentages"] == bool(re.search(r"\d+(?:\.\d+)?%", m[0]))
    assert compounds.compound_entities(df, "doc_id", "text", "other").first()["domain"] == "other"
    assert compounds.compound_entities(df.where("doc_id < -11"), "doc_id", "text").count() == 0


def _by_hand(text, size, overlap, marks):
    """The splitter on strings: cut by the first mark that occurs, join what is short, split what is long by later marks."""
    mark, *later = marks[next(i for i, m in enumerate(marks) if m in text) :]
    parts = [p for p in re.split(f"(?={re.escape(mark)})", text) if p] if mark else list(text)
    out, held = [], []

    def flush(keep):
        out.append("".join(held).strip())
        while held and keep(sum(map(len, held))):
            held.pop(0)

    for p in parts:
        if len(p) < size:
            if held and sum(map(len, held)) + len(p) > size:
                flush(lambda n: n > overlap or n + len(p) > size)
            held.append(p)
            continue
        if held:
            flush(lambda n: True)
        out += _by_hand(p, size, overlap, later) if later else [p.strip()]
    if held:
        flush(lambda n: True)
    return [x for x in out if x]


def test_splitter_against_strings():
    pick = random.Random(5)
    for _ in range(3000):
        # Marks of one kind don't overlap here: a look-ahead would see "\n\n" twice in three line ends.
        text = "".join(pick.choices(["a", "bcd ", "\n\nx", "\ny", "z. ", "wwwwwwww", "  q"], k=pick.randint(1, 60)))
        size, overlap = pick.randint(5, 30), pick.randint(0, 4)
        got = chunking.split_text(text, size, overlap)
        assert [t for _, t in got] == _by_hand(text, size, overlap, list(chunking.MARKS)), (text, size, overlap)
        assert all(text.startswith(t, a) for a, t in got)


def test_cuts_go_around_compounds():
    text = "word " * 100
    assert chunking.split_around(text, []) == chunking.split_text(text)
    cut = lambda *e: [a + len(t) for a, t in chunking.split_around("x" * 300, list(e), 100, 10)]
    assert cut((0, 1, True)) == [100, 200, 300]
    assert cut((90, 130, True)) == [90, 190, 290, 300]
    assert cut((60, 110, True)) == [110, 210, 300]
    assert cut((60, 110, False), (70, 120, True)) == [100, 200, 300]
    assert cut((0, 300, True)) == [100, 300]  # too near the start of the first piece, then nearer the end
    assert cut((20, 290, True)) == [100, 290, 300]
    said = "x" * 30 + ". " + "y" * 268
    assert [a + len(t) for a, t in chunking.split_around(said, [(20, 290, True)], 100, 10)][0] == 31
    for e in [(a, b, True) for a in range(0, 300, 23) for b in range(a, 320, 17)]:
        found = chunking.split_around(said, [e], 100, 10)
        assert found[-1][0] + len(found[-1][1]) == 300 and len(found) <= 300


def test_chunks_of_a_frame(spark):
    rows = [(1, "x" * 1300, [(1190, 1250, True), (None, 3, True)]), (2, "a b", None), (3, None, []), (4, "", [(0, 1, False)])]
    df = spark.createDataFrame(rows, "k int, t string, e array<struct<start:long,end:long,compound:boolean>>")
    got = chunking.split_documents(df, "k", "t", entities="e").collect()
    assert [(r["k"], r["chunk_order"], r["start"], len(r["chunk_text"])) for r in got] == [(1, 0, 0, 1190), (1, 1, 1140, 160), (2, 0, 0, 3)]
