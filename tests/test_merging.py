"""Merged clusters against plain dictionaries, and every cut of an answer against its records."""

import collections
import json
import time

from oracle import compare
from pyspark.sql import functions as F
from textloom.operators import clusters
from textloom.operators import model_answers as A
from textloom.plans import merging, registry


def test_against_sql(spark, folder):
    for name in ("merged_entities", "merged_metadata", "recovered_answers"):
        assert compare(registry.queries()[name](spark, folder), registry.oracle_sql()[name], folder) is None, name


def test_merged(spark, folder):
    rows = merging._rows(spark, folder).collect()
    lists, members = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        for k, values in (r["metadata"] or {}).items():
            lists[r["cluster"], k] += values or []
        members[r["cluster"]].append(r)
    got = clusters.merged_lists(merging._rows(spark, folder), ["cluster"], "v", "metadata")
    found = collections.defaultdict(collections.Counter)
    for r in got.collect():
        found[r["cluster"], r["key"]][r["value"]] = r["times"]
    assert {k: v for k, v in found.items() if k[1] != "original_mentions"} == {k: collections.Counter(v) for k, v in lists.items() if v}
    maps = {r["cluster"]: r["metadata"] for r in clusters.as_maps(got, ["cluster"]).collect()}
    one = {r["cluster"]: r for r in registry.queries()["merged_entities"](spark, folder).collect()}
    assert set(one) == set(members)
    for c, rs in members.items():
        said = sorted({r["v"] for r in rs if r["v"] is not None})
        assert one[c]["size"] == len(rs) and one[c]["mentions"] == len(said) and maps.get(c, {}).get("original_mentions", []) == said
    assert one["-tie"]["entity_value"] == "a one" and (one["-null"]["entity_value"], one["-null"]["confidence"]) == ("only", 0.0) and one["-nothing"]["entity_value"] is None
    empty = merging._rows(spark, folder).limit(0)
    assert clusters.merged(empty, ["cluster"], "v", "c", F.lit("CROP")).count() == 0 == clusters.merged_lists(empty, ["cluster"], "v", "metadata").count()


ENTITIES = [
    {"type": "Product", "value": 'P "x" {1}', "context": "a, b\\"},
    {"type": "Crop", "value": "é☃", "context": "]}"},
    {"type": "Dose", "value": "5 g", "context": "", "n": [1, {"a": None}], "more": True},
    {"type": "No value", "value": 5},
    {"type": "Last", "value": "z"},
]


def test_every_cut():
    """Each cut gives the entities complete by then, and the last one's fields if they include a type and a value."""
    for indent, ascii_ in ((None, True), (2, False), (0, True)):
        text = json.dumps({"entities": ENTITIES, "relationships": [{"source": "a", "n": 12}, "b"]}, indent=indent, ensure_ascii=ascii_)
        before = [text[: text.index(json.dumps(e["value"], ensure_ascii=ascii_)) + len(json.dumps(e["value"], ensure_ascii=ascii_))] for e in ENTITIES]
        for cut in range(len(text) + 1):
            state, found, related = A.entities(text[:cut])
            want = [e for e, b in zip(ENTITIES, before) if len(b) <= cut and isinstance(e["value"], str)]
            assert [(e["type"], e["value"]) for e in found] == [(e["type"], e["value"]) for e in want], text[:cut]
            assert all(f["context"] in ("", e.get("context", "")) for f, e in zip(found, want)) and [f["context"] for f in found[:-1]] == [e.get("context", "") for e in want[: len(found) - 1]]
            assert state == ("whole" if cut == len(text) else "closed" if cut else "none")
        assert [json.loads(r) for r in A.entities(text)[2]] == [{"source": "a", "n": 12}, "b"]


def test_spoilt():
    one = '{"type": "A", "value": "1", "context": "c"}'
    assert A.entities(f'{{"entities": [{one} {one}]')[:2] == ("fields", [{"type": "A", "value": "1", "context": "c"}] * 2)
    assert A.entities('{"type": "A", "value": "1", "x": oops "type": "B", "value": "2"')[1] == [{"type": "A", "value": "1", "context": ""}, {"type": "B", "value": "2", "context": ""}]
    assert A.entities("no JSON") == ("none", [], []) and A.entities("[1, 2]")[0] == "none" and A.entities('{"entities": 5}')[:2] == ("whole", [])
    assert A.entities('Sure: {"entities": [{"type": "A", "value": "\\ud800"}]} Done.')[:2] == ("closed", [{"type": "A", "value": "�", "context": ""}])
    began = time.time()
    for text in ("{" * 200_000, '{"a":' * 100_000, '{"type": "a", "value": "b"' + " " * 200_000, '"' * 200_000, "[" * 100_000 + "]" * 100_000, '{"type": "a", "value": "b", ' * 30_000, '{"a": "b", ' * 50_000):
        A.entities(text)
    assert time.time() - began < 10


def test_recovered(spark):
    fenced = '```json\n{"entities": [{"type": "A", "value": "1"}], "relationships": []}\n```'
    rows = [(1, fenced), (2, None), (3, ""), (4, fenced[:-12]), (1, fenced), (5, "```\n{}\n```  \n")]
    got = sorted((r["k"], r["state"], [tuple(e) for e in r["entities"]]) for r in A.recovered(spark.createDataFrame(rows, "k long, a string").withColumn("state", F.lit("clash")), "k", "a").collect())
    assert got == [(1, "whole", [("A", "1", "")])] * 2 + [(2, "none", []), (3, "none", []), (4, "closed", [("A", "1", "")]), (5, "whole", [])]
    assert A.recovered(spark.createDataFrame([], "k string, a string"), "k", "a").count() == 0
