"""Questions made ready for retrieval: domain, intent, mentions, candidate entities, match scores, expansion."""

from __future__ import annotations

import difflib
import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import hits, ladder
from textloom.operators.question_values import (
    DOCUMENT_TYPES,
    DOMAIN_TERMS,
    DOMAIN_WORDS,
    INTENT_TERMS,
    INTENTS,
    MENTIONS,
    MENTIONS_OF,
    RELEVANCE,
    SYNONYMS,
    TYPE_TERMS,
)

#: Weights of the parts of a match score, and what a match must exceed (fixed values).
WEIGHTS = {"intent_part": 0.3, "text_part": 0.4, "pattern_part": 0.15, "context_part": 0.1, "frequency_part": 0.05}
LEAST_SCORE = 0.2


def rule_domain(text: Column) -> Column:
    """The domain with most keywords; mixed where two tie or general ones occur; agricultural without any."""
    n = {k: hits(text, v) for k, v in DOMAIN_WORDS.items()}
    legal, food, farm, mixed = n["legal"], n["food_industry"], n["agricultural"], n["mixed"]
    return ladder("agricultural", (legal > F.greatest(food, farm), "legal"), (food > farm, "food_industry"), (farm > food, "agricultural"), ((mixed > 0) | (food > 0), "mixed"))


def with_intents(questions: DataFrame, text: str) -> DataFrame:
    """intent, intent_score and multi_intent: a match counts its share of the text, less the later it starts.

    A question without any match is general with score 0, as is an empty or
    null one.
    """
    patterns = [(name, p) for name, listed in INTENTS.items() for p in listed]
    found = questions.withColumn("_found", F.array(*[F.regexp_extract(text, f"(?i){p}", 0) for _, p in patterns]))
    n = F.length(text)

    def strength(i: int) -> Column:
        part = F.get("_found", F.lit(i))
        return F.when(F.length(part) > 0, F.length(part) / n * (1 - (F.instr(F.col(text), part) - 1) / n * 0.3)).otherwise(0.0)

    scores = [F.struct(F.least(F.lit(1.0), reduce(lambda a, b: a + b, [strength(i) for i, (k, _) in enumerate(patterns) if k == name])).alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")) for place, name in enumerate(INTENTS)]
    scored = found.withColumn("_scores", F.array(*scores)).withColumn("_best", F.array_max("_scores"))
    hit = F.col("_best")["score"] > 0
    return scored.withColumns(
        {
            "intent": F.when(hit, F.col("_best")["name"]).otherwise("general"),
            "intent_score": F.when(hit, F.round(F.col("_best")["score"], 6)).otherwise(0.0),
            "multi_intent": F.size(F.filter("_scores", lambda s: s["score"] > 0.3)) > 1,
        }
    ).drop("_found", "_scores", "_best")


def mentions_in(text: str, domain: str, known: dict[str, list[str]]) -> list[tuple]:
    """(start, end, value, kind, confidence) of mentions that don't overlap, surer ones first.

    Named examples (0.9) go before patterns (0.8); of equals the one listed first.
    """
    low, listed = text.lower(), []
    for examples in known.values():
        places = ((low.find(e.lower()), e) for e in examples)
        listed += [(at, at + len(e), e, "known_entity", 0.9) for at, e in places if at >= 0 and e]
    for kind in MENTIONS_OF.get(domain, list(MENTIONS)):
        listed += [(m.start(), m.end(), m[1].strip(), kind, 0.8) for m in re.finditer(MENTIONS[kind], text, re.IGNORECASE)]
    kept: list[tuple] = []
    for one in listed:
        if all(one[1] <= other[0] or one[0] >= other[1] for other in kept):
            kept.append(one)
    return kept


def mentions(questions: DataFrame, key: str, text: str, domain: str, known: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per mention; ``known`` is configuration: example names by entity type."""
    kind = questions.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, i, *m) for k, t, d in zip(*[c.to_pylist() for c in batch.columns]) for i, m in enumerate(mentions_in(t or "", d, known or {}))]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            names = [key, "place", "start", "end", "value", "kind", "confidence"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    return questions.select(key, text, domain).mapInArrow(run, f"`{key}` {kind}, place int, start long, end long, value string, kind string, confidence double")


def search_terms(mentioned: Column, text: Column, most: int = 5) -> Column:
    """The first terms of over two characters: mentions, then words."""
    words = F.filter(F.split(text, "\\s+"), lambda w: F.length(w) > 2)
    return F.slice(F.concat(F.filter(mentioned, lambda m: F.length(m) > 2), words), 1, most)


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def candidates(questions: DataFrame, key: str, terms: str, entities: DataFrame, value: str, order: list[Column], per_term: int = 20, most: int = 50) -> DataFrame:
    """Entities whose value contains a term, whatever the case: the best of each term, once each, the first of each question."""
    return candidate_lists(questions, key, terms, entities, value, order, per_term, most).select(key, F.inline("candidates"))


def candidate_lists(questions: DataFrame, key: str, terms: str, entities: DataFrame, value: str, order: list[Column], per_term: int = 20, most: int = 50) -> DataFrame:
    """key, candidates: the rows of candidates() as one array for each question that has any.

    Containment is an equality join on the term's rarest three characters, then
    checked; each distinct term is looked up once, and each distinct list of
    terms is answered once, so that a frequent term's questions never meet its
    entities in one task. ``order`` must decide every tie. Terms of fewer than
    three characters find nothing.
    """
    every = asked_terms(questions, key, terms)
    return every.join(answers(every, entities, value, order, per_term, most), "_asked").select(key, "candidates")


def asked_terms(questions: DataFrame, key: str, terms: str) -> DataFrame:
    """key, _asked: the terms of each question in lower case with their places, sorted."""
    numbered = F.transform(terms, lambda t, i: F.struct(i.alias("term_place"), F.lower(t).alias("_term")))
    return questions.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(numbered))).alias("_asked"))


def answers(every: DataFrame, entities: DataFrame, value: str, order: list[Column], per_term: int = 20, most: int = 50) -> DataFrame:
    """_asked, candidates: one row for each distinct list of terms that finds any."""
    asked = every.select("_asked").distinct().select("_asked", F.inline("_asked"))
    named = entities.withColumn("_low", F.lower(value))
    index = named.where(F.length("_low") >= 3).select("_low", F.explode(_grams(F.col("_low"))).alias("_gram")).distinct()
    sizes = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    parts = asked.select("_term").distinct().where(F.length("_term") >= 3).select("_term", F.explode(_grams(F.col("_term"))).alias("_gram"))
    rarest = parts.join(sizes, "_gram").groupBy("_term").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    found = rarest.join(index, "_gram").where(F.contains("_low", F.col("_term"))).select("_term", "_low").join(named, "_low")
    best = found.withColumn("term_rank", F.row_number().over(Window.partitionBy("_term").orderBy(*order))).where(F.col("term_rank") <= per_term)
    own = asked.join(best, "_term")
    first = own.withColumn("_first", F.row_number().over(Window.partitionBy("_asked", "_low").orderBy("term_place", "term_rank"))).where("_first = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("_asked").orderBy("term_place", "term_rank"))).where(F.col("place") <= most)
    return placed.groupBy("_asked").agg(F.collect_list(F.struct(*entities.columns, "place")).alias("candidates"))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != ""))


def match_scores(pairs: DataFrame, question: str, intent: str, value: str, kind: str, context: str, share: str) -> DataFrame:
    """Parts and score of each (question, entity) pair, and why; pairs of at most LEAST_SCORE go.

    ``share`` is the entity's frequency over the greatest. Only pairs without a
    common word or phrase go through Python, for their sequence ratio.
    """
    q, v = F.lower(F.col(question)), F.lower(F.coalesce(F.col(value), F.lit("")))
    within = F.contains(q, v)
    worded = F.exists(_word_set(v), lambda w: F.contains(q, w))
    unlike = ~within & ~worded
    ratio = _ratio(F.when(unlike, q), F.when(unlike, v))
    own, theirs = _word_set(v), _word_set(q)
    union = F.size(F.array_union(own, theirs))
    jaccard = F.when(union > 0, F.size(F.array_intersect(own, theirs)) / union + F.when(within, 0.5).otherwise(0.0)).otherwise(0.0)
    shared = F.size(F.array_intersect(_word_set(F.coalesce(F.col(context), F.lit(""))), theirs)) / F.greatest(F.size(theirs), F.lit(1))
    relevance = F.lit(0.3)
    for name, weights in RELEVANCE.items():
        of_type = reduce(lambda c, kw: c.when(F.col(kind) == kw[0], kw[1]), weights.items(), F.when(F.lit(False), 0.3)).otherwise(0.3)
        relevance = F.when(F.col(intent) == name, of_type).otherwise(relevance)
    out = pairs.withColumn("_ratio", ratio).withColumns(
        {
            "intent_part": relevance,
            "text_part": F.when(within, 1.0).when(worded, 0.7).when(F.col("_ratio") > 0.3, F.col("_ratio")).otherwise(0.0),
            "pattern_part": F.least(F.lit(1.0), jaccard),
            "context_part": shared,
            "frequency_part": F.coalesce(F.col(share).cast("double"), F.lit(0.0)),
        }
    )
    scored = out.drop("_ratio").withColumn("score", F.round(reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()]), 6))
    return scored.where(F.col("score") > LEAST_SCORE).withColumn("reason", explanation())


def explanation() -> Column:
    said = F.concat_ws(
        "; ",
        F.when(F.col("text_part") > 0.8, "exact text match").when(F.col("text_part") > 0.5, "partial text match"),
        F.when(F.col("intent_part") > 0.8, "highly relevant to query intent").when(F.col("intent_part") > 0.5, "moderately relevant to query intent"),
        F.when(F.col("context_part") > 0.5, "relevant context"),
        F.when(F.col("frequency_part") > 0.7, "frequently mentioned entity"),
    )
    return F.when(said == "", "general relevance").otherwise(said)


def best_matches(scored: DataFrame, keys: list[str], value: str, kind: str, most: int = 5) -> DataFrame:
    """Per question its best matches as an array, best first; only that many reach the aggregation."""
    ranked = scored.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), value))).where(F.col("_rank") <= most)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "score", F.col(value).alias("value"), F.col(kind).alias("kind")))).alias("matches"))


#: What the question asks for, by type of a match and the score it must exceed (fixed values).
PHRASES = [("PRODUCT", 0.7, "product information for "), ("CROP", 0.6, "crop-specific information for "), ("APPLICATION", 0.6, "application methods and "), ("CHEMICAL_COMPOUND", 0.7, "chemical information about ")]


def enhanced_text(text: Column, matches: Column) -> Column:
    """The question and, for its three best matches, what is sought about them."""

    def phrase(m: Column) -> Column:
        (k, least, said), *rest = PHRASES
        first = F.when((m["kind"] == k) & (m["score"] > least), F.concat(F.lit(said), m["value"]))
        return reduce(lambda c, p: c.when((m["kind"] == p[0]) & (m["score"] > p[1]), F.concat(F.lit(p[2]), m["value"])), rest, first)

    return F.array_join(F.concat(F.array(text), F.transform(F.slice(matches, 1, 3), phrase)), " | ")


def enhancement_confidence(matches: Column) -> Column:
    """Scores of the three best weighed 0.5, 0.3, 0.2, and 0.1 more for each above 0.5; at most 1."""
    top = F.transform(F.slice(matches, 1, 3), lambda m: m["score"])
    weighed = F.aggregate(F.transform(top, lambda s, i: s * F.get(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), i)), F.lit(0.0), lambda a, b: a + b)
    return F.round(F.least(F.lit(1.0), weighed + 0.1 * F.size(F.filter(top, lambda s: s > 0.5))), 6)


def _lookup(table: dict[str, list[str]], name: Column) -> Column:
    rows = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(rows, name), F.array().cast("array<string>"))


def synonyms(value: Column, most: int = 3) -> Column:
    """Synonyms of names that contain the value or are contained in it, then the value's own words."""
    low, none = F.lower(value), F.array().cast("array<string>")
    known = [F.when(F.contains(low, F.lit(k)) | F.contains(F.lit(k), low), F.array(*map(F.lit, v))).otherwise(none) for k, v in SYNONYMS.items()]
    words = F.filter(F.split(value, "\\s+"), lambda w: w != "")
    return F.slice(F.concat(*known, F.when(F.size(words) > 1, words).otherwise(none)), 1, most)


def expansion_terms(domain: Column, intent: Column, matches: Column, most: int = 10) -> Column:
    """Terms of the intent, of the matches' types and names, and of the domain: distinct, sorted, the first of them."""
    of_intent = F.lit(None).cast("array<string>")
    for name in ("legal", "food_industry"):
        of_intent = F.when(domain == name, _lookup(INTENT_TERMS[name], intent)).otherwise(of_intent)
    of_intent = F.coalesce(of_intent, _lookup(INTENT_TERMS["agricultural"], intent))
    of_match = F.flatten(F.transform(F.slice(matches, 1, 5), lambda m: F.concat(_lookup(TYPE_TERMS, m["kind"]), F.when(F.length(m["value"]) > 3, synonyms(m["value"])).otherwise(F.array().cast("array<string>")))))
    every = F.concat(of_intent, of_match, _lookup(DOMAIN_TERMS, domain))
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda t: F.length(t) > 1))), 1, most)


def suggested_filters(domain: Column, matches: Column, confidences: Column) -> Column:
    """entity_types, document_types and threshold: the matches' mean confidence less 0.2, 0.3 at least; 0.5 without matches."""
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(matches, lambda m: m["kind"]), lambda k: F.length(k) > 0)))
    n = F.size(confidences)
    mean = F.aggregate(confidences, F.lit(0.0), lambda a, c: a + F.coalesce(c.cast("double"), F.lit(0.5))) / n
    threshold = F.when(n > 0, F.round(F.greatest(F.lit(0.3), mean - 0.2), 6)).otherwise(0.5)
    return F.struct(kinds.alias("entity_types"), _lookup(DOCUMENT_TYPES, domain).alias("document_types"), threshold.alias("threshold"))
