"""Text cleaning, measuring and scoring as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\r\\f\\x0B]"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean(text: Column) -> Column:
    """Lines of at least five characters that are no page mark and not digits alone, in one line."""
    lines = F.transform(F.split(text, "\n"), squeezed)
    kept = F.filter(lines, lambda x: (F.length(x) >= 5) & ~x.rlike("(?i)^page [0-9]+ of [0-9]+$") & ~x.rlike("^[0-9]+$"))
    return squeezed(F.array_join(kept, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms the lowered text contains."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms])


def ladder(default: str, *steps: tuple[Column, str]) -> Column:
    """The name of the first step that holds."""
    (test, name), *rest = steps
    return reduce(lambda c, s: c.when(s[0], s[1]), rest, F.when(test, name)).otherwise(default)


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def length_score(text: Column) -> Column:
    """1 for a short plain name, less for very short, long or wordy ones."""
    n, w = F.length(text), F.size(words(text))
    return F.when(n == 0, 0.0).when(n < 3, 0.1).when(w > 6, 0.3).when((n <= 30) & (w <= 4), 1.0).when((n <= 50) & (w <= 6), 0.8).otherwise(0.6)


def normalized_product(text: Column) -> Column:
    """Hyphens and underscores as blanks, marks dropped; up to three words of A-Z0-9 upper, else each word capitalised."""
    plain = squeezed(F.regexp_replace(F.regexp_replace(text, "[-_]+", " "), "[®™©]", ""))
    few = (F.size(words(plain)) <= 3) & plain.rlike("^[A-Z0-9 ]+$")
    return F.when(few, F.upper(plain)).otherwise(F.initcap(plain))


def normalized_specification(text: Column) -> Column:
    """Unit words as symbols, no blank before a per cent sign, pH written one way."""
    out = text
    for pattern, to in (("(?i)\\bpercent\\b", "%"), ("(?i)\\bkilograms?\\b", "kg"), ("(?i)\\bgrams?\\b", "g"), ("(?i)\\blit(?:er|re)s?\\b", "L"), ("([0-9]) +%", "$1%"), ("(?i)\\bph *[=:]? *([0-9])", "pH $1")):
        out = F.regexp_replace(out, pattern, to)
    return squeezed(out)
