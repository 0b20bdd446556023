"""Documents and queries by keywords: types, domains, intents, modes, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import hits, ladder, words

# Keyword lists (fixed values).
DOMAINS = {
    "agricultural": ["crop", "fertilizer", "soil", "harvest", "pesticide", "seed", "yield"],
    "food": ["ingredient", "allergen", "nutrition", "food", "flavour", "shelf life"],
    "legal": ["contract", "liability", "clause", "agreement", "shall"],
}
INTENTS = {
    "definition": "(?i)\\b(what is|define|meaning of)\\b",
    "comparison": "(?i)\\b(compare|versus|vs|difference)\\b",
    "procedure": "(?i)\\b(how to|how do|steps|procedure)\\b",
    "quantity": "(?i)\\b(how much|how many|rate|dose|amount)\\b",
    "safety": "(?i)\\b(safe|hazard|risk|danger|toxic)\\b",
}
LANGUAGES = {
    "en": ["the", "and", "of", "is", "to"],
    "fr": ["le", "la", "les", "des", "et"],
    "de": ["der", "die", "und", "das", "ist"],
    "es": ["el", "los", "las", "que", "por"],
}


def first_max(scores: dict[str, Column], default: str) -> Column:
    """The name with the greatest score, the earliest of equals; the default if all are zero."""
    best = F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("name")) for i, (k, c) in enumerate(scores.items())]))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def domain(text: Column, default: str = "agricultural") -> Column:
    return first_max({k: hits(text, v) for k, v in DOMAINS.items()}, default)


def language(text: Column, default: str = "en") -> Column:
    """By how many of the words are stop words of a language."""
    known = sorted({w for v in LANGUAGES.values() for w in v})
    few = F.filter(words(F.lower(text)), lambda w: w.isin(known))
    # Bound as a lambda's variable, the stop words of a text are taken out once.
    among = lambda held, stop_words: F.size(F.filter(held, lambda w: w.isin(stop_words)))
    count = lambda held: first_max({k: among(held, v) for k, v in LANGUAGES.items()}, default)
    return F.get(F.transform(F.array(few), count), 0)


def intent(text: Column) -> Column:
    """The intent whose match is longest for its text and nearest the start."""
    scores = {}
    for name, pattern in INTENTS.items():
        found, n = F.regexp_extract(text, pattern, 0), F.greatest(F.length(text), F.lit(1))
        scores[name] = F.when(found != "", F.length(found) / n * (1 - 0.3 * (F.regexp_instr(text, F.lit(pattern)) - 1) / n)).otherwise(0.0)
    return first_max(scores, "general")


def complexity(text: Column) -> Column:
    """One point each for more than ten words, a conjunction, and several questions."""
    low = F.lower(text)
    points = [F.size(words(text)) > 10, F.contains(low, F.lit("and")) | F.contains(low, F.lit("or")), F.regexp_count(text, F.lit("\\?")) > 1]
    return sum((p.cast("int") for p in points), F.lit(0))


def mode(text: Column) -> Column:
    return ladder("simple", (complexity(text) >= 2, "hybrid"), (complexity(text) == 1, "enhanced"))
