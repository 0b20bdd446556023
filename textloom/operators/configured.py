"""Entities by configuration: products by patterns, foods by patterns and examples, with confidences from what stands near.

One Aho-Corasick automaton, built once a worker, holds all example literals and,
for each pattern, literals of which every match contains one. A text is read by
it once; only patterns with such a literal in the text are searched then, and
those without any.

Defined results: null and empty texts have no entities; rows with a null key keep
it; repeated rows give their entities again; places count characters of the text
as it stands.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import entity_config as config


def anchors(pattern: str) -> list[str]:
    """Lower-case literals of which every match of the pattern contains one; none if there is no such set of three characters or more."""
    found = _anchors(_parser.parse(pattern, re.I))
    return found if found and min(map(len, found)) >= 3 else []


def _anchors(parts) -> list[str]:
    sets, run = [], ""
    for op, arg in [*parts, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            sets.append([run])
            run = ""
        if op is C.SUBPATTERN:
            sets.append(_anchors(arg[3]))
        elif op is C.BRANCH:
            each = [_anchors(b) for b in arg[1]]
            sets.append([a for e in each for a in e] if all(each) else [])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            sets.append(_anchors(arg[2]))
    return max((s for s in sets if s), key=lambda s: min(map(len, s)), default=[])


def lowered(text: str) -> str:
    """In lower case, as many characters as before."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("ſ", "s")  # the one other letter that a case-blind s matches


@dataclass
class Matcher:
    """Patterns and examples by kind, compiled together."""

    patterns: dict[str, list[str]]
    examples: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        self._searched: list[tuple[str, int, re.Pattern, list[str]]] = []
        words: dict[str, list[tuple]] = {}
        for kind, listed in self.patterns.items():
            for i, p in enumerate(listed):
                needs = anchors(p)
                self._searched.append((kind, i, re.compile(p, re.I), needs))
                for a in needs:
                    words.setdefault(a, [])
        for kind, listed in self.examples.items():
            for i, e in enumerate(listed):
                words.setdefault(lowered(e), []).append((kind, i, e))
        self._automaton = ahocorasick.Automaton()
        for word, of in words.items():
            self._automaton.add_word(word, (word, of))
        if words:
            self._automaton.make_automaton()
        self._empty = not words

    def find(self, text: str) -> tuple[list[tuple[str, int, int, int, str]], list[tuple[str, int, int, int, str]]]:
        """Matches of patterns and hits of examples: (kind, number of the pattern or example, start, end, value)."""
        low = lowered(text)
        seen, hits = set(), []
        for last, (word, of) in () if self._empty else self._automaton.iter(low):
            seen.add(word)
            if of:
                start, end = last + 1 - len(word), last + 1
                if not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                    hits += [(kind, i, start, end, e) for kind, i, e in of]
        matches = [(kind, i, m.start(), m.end(), m[0].strip()) for kind, i, p, needs in self._searched if not needs or not seen.isdisjoint(needs) for m in p.finditer(text)]
        return matches, hits


def near(text: str, start: int, end: int, reach: int) -> str:
    return text[max(0, start - reach) : end + reach].strip()


# products


def _product_confidence(context: str, words: list[str]) -> float:
    if not words:
        return 0.5
    low = context.lower()
    return min(0.3 + sum(w.lower() in low for w in words) / len(words) * 0.7, 1.0)


def normalized(value: str, kind: str) -> tuple[str, str | None, float | None]:
    """The value in one form, its unit, and its number."""
    rules = config.NORMALIZE.get(kind, {})
    out, unit, number = value.strip(), None, None
    for mark in rules.get("remove", ()):
        out = out.replace(mark, "")
    out = {"lower": str.lower, "upper": str.upper, "title": str.title}.get(rules.get("case"), str)(out)
    unit = next((new for old, new in rules.get("units", {}).items() if old in out.lower()), None)
    if kind == "SPECIFICATION" and (m := re.search(r"(\d+(?:\.\d+)?)", out)):
        number = float(m[1])
        said = re.search(r"(\d+(?:\.\d+)?)\s*([a-zA-Z%°]+)", out)
        unit = unit or (said and said[2])
    return out, unit, number


def valid(value: str, kind: str) -> bool:
    rules = config.VALIDATE.get(kind, {})
    return (
        rules.get("min_length", 0) <= len(value) <= rules.get("max_length", len(value))
        and not any(c in value for c in rules.get("forbidden", ()))
        and ("pattern" not in rules or re.match(rules["pattern"], value) is not None)
        and (not rules.get("uppercase") or (not value.islower() and any(c.isupper() for c in value)))
    )


def first_of_each(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, value, ...) of one kind in order of their starts, without those whose text was met or of which more than half, or more than half of a kept one, is covered."""
    kept, said, open_ = [], set(), []
    for s in sorted(spans, key=lambda s: s[0]):
        open_ = [o for o in open_ if o[1] > s[0]]  # starts only grow: spans that end here can't overlap later ones
        low = s[2].lower()
        if low in said or any(min(s[1], b) - max(s[0], a) > 0.5 * min(s[1] - s[0], b - a) for a, b in open_):
            continue
        said.add(low)
        open_.append(s[:2])
        kept.append(s)
    return kept


def product_entities(text: str, matcher: Matcher) -> list[tuple]:
    """(kind, value, confidence, start, end, context, normalized, unit, number), by kind, best first."""
    by_kind: dict[str, list[tuple]] = {k: [] for k in matcher.patterns}
    for kind, _, start, end, value in matcher.find(text)[0]:
        if valid(value, kind):
            by_kind[kind].append((start, end, value))
    out = []
    for kind, spans in by_kind.items():
        told = []
        for start, end, value in first_of_each(spans):
            context = near(text, start, end, 100)
            told.append((kind, value, _product_confidence(context, config.PRODUCT_KEYWORDS.get(kind, [])), start, end, context, *normalized(value, kind)))
        out += sorted(told, key=lambda t: -t[2])
    return out


# foods

_VALUES = {k: re.compile(p, re.I) for k, p in config.FOOD_VALUES.items()}
_BONUSES = {k: (re.compile(p), more) for k, (p, more) in config.FOOD_BONUSES.items()}


def _food_confidence(kind: str, context: str) -> float:
    low = context.lower()
    out = 0.5 + sum(w in low for w in config.FOOD_INDICATORS.get(kind, ())) * 0.15
    if kind in _BONUSES and _BONUSES[kind][0].search(low):
        out += _BONUSES[kind][1]
    return min(out, 1.0)


def food_info(kind: str, context: str) -> tuple:
    """(nutritional value, its unit, regulatory status, allergens contained, free of, shelf life, food grade) from what stands near."""
    value = unit = status = contained = free = life = None
    at = lambda k: _VALUES[k].search(context)
    if kind == "NUTRITIONAL_COMPONENT":
        for k in ("vitamin", "mineral"):  # a mineral's counts where both are found
            if m := at(k):
                value, unit = float(m[2]), m[3]
    if kind == "FOOD_SAFETY_STANDARD":
        status = "GRAS approved" if at("gras") else None
        if m := at("e_number"):
            status = f"E{m[1]}"
    if kind == "ALLERGEN_INFO":
        if m := at("contains"):
            contained = [a.strip() for a in m[1].split(",")]
        if m := at("free"):
            contained, free = None, m[1]
    if m := at("shelf_life"):
        life = f"{m[1]} {m[2]}"
    low = context.lower()
    return value, unit, status, contained, free, life, True if "food grade" in low or "food quality" in low else None


def food_entities(text: str, foods: Matcher, products: Matcher | None) -> list[tuple]:
    """Tuples of product_entities() and food_info(): foods by kind, patterns before examples, then products if asked for."""
    matches, hits = foods.find(text)
    by_kind: dict[str, list[tuple]] = {k: [] for k in foods.patterns}
    for found, reach, least in ((matches, 150, 0.5), (sorted(hits, key=lambda h: (h[1], h[2])), 100, 0.6)):
        for kind, _, start, end, value in found:
            context = near(text, start, end, reach)
            score = _food_confidence(kind, context)
            if score > least:
                info = food_info(kind, context)
                by_kind[kind].append((kind, value, score, start, end, context, value, info[1], None, *info))
    out = [e for each in by_kind.values() for e in each]
    return out + [(*e, *food_info(e[0], e[5])) for e in (product_entities(text, products) if products else ())]


PRODUCT_COLUMNS = "kind string, value string, confidence double, start long, end long, context string, normalized string, unit string, number double"
FOOD_COLUMNS = PRODUCT_COLUMNS + ", nutritional_value double, nutritional_unit string, regulatory_status string, contains array<string>, free_from string, shelf_life string, food_grade boolean"


def _each(docs: DataFrame, key: str, text: str, columns: str, build) -> DataFrame:
    """Rows of (key, place: the row's number within the text, columns); build gives a worker its function of a text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(f"place int, {columns}")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = build()
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                rows = [(k, i, *r) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, r in enumerate(of(t or ""))]
                columns = zip(*rows) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)


def products(docs: DataFrame, key: str, text: str, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Product entities of every text, one row each."""

    def build():
        matcher = Matcher(patterns or config.PRODUCT_PATTERNS)
        return lambda t: product_entities(t, matcher)

    return _each(docs, key, text, PRODUCT_COLUMNS, build)


def foods(docs: DataFrame, key: str, text: str, and_products: bool = True) -> DataFrame:
    """Food entities of every text, and product entities after them, with what stands near, one row each."""

    def build():
        food, product = Matcher(config.FOOD_PATTERNS, config.FOOD_EXAMPLES), Matcher(config.PRODUCT_PATTERNS) if and_products else None
        return lambda t: food_entities(t, food, product)

    return _each(docs, key, text, FOOD_COLUMNS, build)


def example_hits(docs: DataFrame, key: str, text: str, examples: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, kind, value, hits): how often each example stands in a text as whole words."""

    def build():
        matcher = Matcher({}, examples or config.FOOD_EXAMPLES)
        return lambda t: [(kind, value) for kind, _, _, _, value in matcher.find(t)[1]]

    return _each(docs, key, text, "kind string, value string", build).groupBy(key, "kind", "value").agg(F.count("*").alias("hits"))


# relations of foods


class Holders:
    """Entities of a text in order, asked for the first that a phrase holds or that holds the phrase."""

    def __init__(self, entities: list[tuple]):
        self.entities = entities
        texts = [e[1].lower() for e in entities]
        firsts: dict[str, int] = {}
        for i, e in enumerate(entities):
            for v in (texts[i], (e[6] or "").lower()):
                if v:
                    firsts.setdefault(v, i)
        self._automaton = ahocorasick.Automaton()
        for v, i in firsts.items():
            self._automaton.add_word(v, i)
        self._automaton.make_automaton()
        used = set().union(*texts)
        self._between = next(c for c in map(chr, range(0xE000, 0x10FFFF)) if c not in used)
        self._joined = self._between.join(texts)
        self._starts = [0]
        for t in texts[:-1]:
            self._starts.append(self._starts[-1] + len(t) + 1)

    def first(self, phrase: str) -> tuple | None:
        low = phrase.lower().strip()
        best = min((i for _, i in self._automaton.iter(low)), default=len(self.entities))
        at = -1 if self._between in low else self._joined.find(low)
        if at >= 0:
            best = min(best, bisect.bisect_right(self._starts, at) - 1)
        return self.entities[best] if best < len(self.entities) else None


def _relation_confidence(kind: str, context: str, source: tuple, target: tuple) -> float:
    low = context.lower()
    out = min(sum(w in low for w in config.RELATION_INDICATORS.get(kind, ())) * 0.25, 0.7)
    out += 0.2 * ((source[0], target[0]) in config.RELATION_PAIRS.get(kind, ()))
    out += 0.1 * any(w in low for w in config.RELATION_WORDS)
    return min(out, 1.0)


#: A phrase, white space, the verb, white space and the rest of the sentence; the phrase ends where white space begins, so a run of it is read once.
_VERBS = [(kind, p, re.compile(rf"(.+?)(?:(?<!\s)|(?<=\A.))\s++{p}\s+(.+)", re.I | re.S), anchors(p)) for kind, listed in config.FOOD_RELATIONS.items() for p in listed]


def verb_matches(text: str) -> list[tuple[str, re.Match]]:
    """(kind, match) of every verb in every sentence: the phrase before it is group 1, the one after it group 2."""
    low = lowered(text)
    verbs = [v for v in _VERBS if any(a in low for a in v[3])]
    sentences = [(s, lowered(s)) for s in text.split(".")] if verbs else []
    return [(kind, m) for kind, _, verb, needs in verbs for sentence, said in sentences if any(a in said for a in needs) and (m := verb.match(sentence))]


def relations_of(text: str, entities_of) -> list[tuple]:
    """(kind, source, source kind, target, target kind, confidence, context): sentences with a verb between an entity and another.

    entities_of gives the entities of a text; it is asked only where a verb was found.
    """
    said = verb_matches(text)
    entities = entities_of(text) if said else []
    if not entities:
        return []
    holders, out = Holders(entities), []
    for kind, m in said:
        source, target = holders.first(m[1]), holders.first(m[2])
        if source and target:
            score = _relation_confidence(kind, m[0], source, target)
            if score > 0.5:
                out.append((kind, source[1], source[0], target[1], target[0], score, m[0]))
    return out


def food_relations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Relations between the food entities of every text, one row each."""

    def build():
        food, product = Matcher(config.FOOD_PATTERNS, config.FOOD_EXAMPLES), Matcher(config.PRODUCT_PATTERNS)
        return lambda t: relations_of(t, lambda t: food_entities(t, food, product))

    return _each(docs, key, text, "kind string, source string, source_kind string, target string, target_kind string, confidence double, context string", build)
