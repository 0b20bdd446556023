"""Tables in text against plain Python, line by line and brace by brace."""

import json
import random
import time

from oracle import compare
from textloom.operators import text_tables
from textloom.plans import registry, tables


def plain_tables(text):
    out, run, number = [], [], 0

    def close():
        best, most = None, 0
        for sep in ["|", "\t", ",", "  "]:
            counts = {len(x.split(sep)) for x in run}
            if len(counts) == 1 and max(counts) > 1 and max(counts) > most:
                best, most = sep, max(counts)
        rows = [c for c in ([c.strip() for c in x.split(best) if c.strip()] for x in run) if c] if best and len(run) > 1 else []
        if len(rows) > 1:
            out.append((number, best, rows[0], rows[1:]))

    for line in [*text.split("\n"), ""]:
        line = line.strip()
        if max(line.count(s) for s in "|\t,") >= 2 or line.count("  ") >= 2:
            if len(line.split()) >= 3:
                number += not run
                run.append(line)
                continue
        if run:
            close()
        run = []
    return out


def test_separated_tables(spark, folder):
    rng = random.Random(6)
    made = [(100 + i, "".join(rng.choice(["a", "b c", "|", "|", ",", "\t", "  ", "\n", "\n", " ", "\x1c", " ", "é"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows = [*tables.TEXTS, *made]
    got = sorted((r["k"], r["table_no"], r["separator"], r["headers"], r["rows"]) for r in text_tables.separated_tables(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect())
    assert got == sorted((k, *t) for k, text in rows if text for t in plain_tables(text))
    assert {g[2] for g in got} == {"|", "\t", ",", "  "} and not {-6, -7, -9} & {g[0] for g in got if g[0] != -7}
    name = "separated_tables"
    assert compare(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder) is None


def test_json_spans():
    """Every object that stands in prose is found whole, whatever its strings hold."""
    rng = random.Random(7)
    for _ in range(300):
        objects = [json.dumps({"a": rng.choice(["}", '"', "\\", "{", "x"]), "b": [{"c": {}}] * rng.randint(0, 2)}) for _ in range(rng.randint(0, 4))]
        text = "".join(rng.choice(['say "hi" ', "} ", "plain ", "it's 5\" "]) + o for o in objects)
        assert [text[a:b] for a, b in text_tables.json_spans(text)] == objects
    assert text_tables.json_spans('{"a": {"b": 1}, {"c": 2}') == [(6, 14), (16, 24)]
    began = time.time()
    for text in ("{" * 300_000, "{}" * 200_000, '{"' * 200_000, "{" * 100_000 + "}" * 100_000, "\\" * 300_000):
        text_tables.json_spans(text)
    assert time.time() - began < 10


def test_json_tables(spark, folder):
    got = {(r["doc_id"], r["table_no"]): (r["table_type"], r["headers"], r["rows"], r["caption"]) for r in registry.queries()["json_tables"](spark, folder).where("doc_id < 0").collect()}
    assert got == {(-8, 1): ("lab", ["a", "b"], [["1", "2"], ["{3}", '"}']], ""), (-8, 2): ("n", [], [], "c")}
    assert text_tables.json_tables(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0
