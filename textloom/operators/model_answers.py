"""Entities from a model's JSON answers, whole, cut off or spoilt.

A cut-off answer is closed after its last complete member, in one pass over its
marks; where that is no JSON either, pairs of a type and a value are looked for.

Defined results: null and empty answers, and answers that name no entity, give
empty lists; an entity needs a type and a value, and has an empty context where
none is whole; repeated rows give their entities each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities of spoilt JSON: whole ones, then pairs of a type and a value (fixed values; spaces aren't given back, for speed alone).
RECORD = re.compile(r'\{\s*+"type":\s*+"([^"]+)"\s*+,\s*+"value":\s*+"([^"]+)"(?:\s*+,\s*+"context":\s*+"([^"]*)")?\s*+(?:,\s*+"[^"]*":\s*+"[^"]*")*+\s*+\}')
PAIR = re.compile(r'"type":\s*+"([^"]+)"\s*+,\s*+"value":\s*+"([^"]+)"')
_MARKS = re.compile(r'["\\{}\[\],:]')
_CLOSE = {"{": "}", "[": "]"}


def unfenced(answer: Column) -> Column:
    """Without the lines that fence code, and white space at the ends."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?m)^```json\s*+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)^```\s*$", ""), r"```\z", "")
    return F.regexp_replace(plain, r"^\s++|(?<!\s)\s+\z", "")


def _read(text: str) -> tuple[int, list[str], bool]:
    """(end, closers, done): up to where the outermost value's members are complete, what is open there, and whether nothing is."""
    opened: list[str] = []
    end, quoted, skip, name = 0, False, -1, False
    for m in _MARKS.finditer(text):
        at, mark = m.start(), m[0]
        if at == skip:
            continue
        if quoted:
            if mark == "\\":
                skip = at + 1
            elif mark == '"':
                quoted = False
                end = end if name else at + 1
        elif mark == '"':
            quoted = True
        elif mark in _CLOSE:
            opened.append(_CLOSE[mark])
            end, name = at + 1, mark == "{"
        elif mark == ":":
            name = False
        elif mark == ",":
            end, name = at, bool(opened) and opened[-1] == "}"
        elif not opened or opened.pop() != mark:
            return end, opened, False
        else:
            end, name = at + 1, False
            if not opened:
                return end, opened, True
    return end, opened, False


def closed(text: str) -> str | None:
    """The text up to its last complete member, with what is open there closed; None if it holds no JSON."""
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    text = text[start.start() :]
    end, _, done = _read(text)
    kept = text[:end]
    return kept if done else kept + "".join(reversed(_read(kept)[1]))


def _parsed(text: str | None) -> dict | None:
    try:
        found = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _plain(text: str) -> str:
    """Halves of pairs that a cut or a slip left alone can't be stored."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def entities(text: str) -> tuple[str, list[dict], list[str]]:
    """(state, entities, relationships): read whole, closed, by fields, or none."""
    state, found = "whole", _parsed(text)
    if found is None:
        state, found = "closed", _parsed(closed(text))
    if found is None:
        whole = [m.groups(default="") for m in RECORD.finditer(text)]
        values = {value for _, value, _ in whole}
        for kind, value in (m.groups() for m in PAIR.finditer(text)):
            if value not in values:
                values.add(value)
                whole.append((kind, value, ""))
        return "fields" if whole else "none", [{"type": k, "value": v, "context": c} for k, v, c in whole], []
    listed = lambda name: found[name] if isinstance(found.get(name), list) else []
    kept = [e for e in listed("entities") if isinstance(e, dict) and isinstance(e.get("type"), str) and isinstance(e.get("value"), str)]
    text_of = lambda e: e["context"] if isinstance(e.get("context"), str) else ""
    return state, [{"type": _plain(e["type"]), "value": _plain(e["value"]), "context": _plain(text_of(e))} for e in kept], [json.dumps(r) for r in listed("relationships")]


def recovered(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, state, entities, relationships) of every answer."""
    kind = answers.schema[key].dataType.simpleString()
    entity = pa.struct([("type", pa.string()), ("value", pa.string()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state, found, related = zip(*map(entities, batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state, pa.string()), pa.array(found, pa.list_(entity)), pa.array(related, pa.list_(pa.string()))], [key, "state", "entities", "relationships"])

    plain = answers.select(key, unfenced(F.col(answer)).alias("_answer"))
    return plain.mapInArrow(run, f"{key} {kind}, state string, entities array<struct<type:string,value:string,context:string>>, relationships array<string>")
