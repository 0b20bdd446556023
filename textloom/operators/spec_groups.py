"""Related specifications of a text as one: by place, category, or a word of their properties.

The rule is seed-ordered and not transitive: the first specification not yet
placed takes all later ones that are related to it itself. Each text is grouped
by itself; an index by place, one by category and one by word give a seed its
relations, and what is placed leaves them, so a text takes near-linear time.

Defined results: specifications are taken in order of their places; a null
category is one like any other, a null property has no words; rows whose place
is null come first and are near no other; repeated rows are related like any
others; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups_of(starts: list, categories: list, properties: list, reach: int = 300) -> list[list[int]]:
    """Numbers of related specifications, group by group; the first of each is its seed."""
    size = len(starts)
    by_category: dict = {}
    by_word: dict[str, list[int]] = {}
    words = [set((p or "").lower().split()) for p in properties]
    for i in range(size):
        by_category.setdefault(categories[i], []).append(i)
        for w in words[i]:
            by_word.setdefault(w, []).append(i)
    placed = sorted((s, i) for i, s in enumerate(starts) if s is not None)
    at = {i: n for n, (_, i) in enumerate(placed)}
    after = list(range(len(placed) + 1))  # the next place that is free, with paths cut short

    def free(n: int) -> int:
        while after[n] != n:
            after[n] = after[after[n]]
            n = after[n]
        return n

    used, out = [False] * size, []

    def take(i: int, group: list[int]) -> None:
        if not used[i]:
            used[i] = True
            group.append(i)
            if i in at:
                after[at[i]] = at[i] + 1

    for seed in range(size):
        if used[seed]:
            continue
        group: list[int] = []
        take(seed, group)
        if starts[seed] is not None:
            n = free(bisect.bisect_right(placed, (starts[seed] - reach, size)))
            while n < len(placed) and placed[n][0] < starts[seed] + reach:
                take(placed[n][1], group)
                n = free(n)
        for index in (by_category.pop(categories[seed], []), *[by_word.pop(w, []) for w in words[seed]]):
            for i in index:
                take(i, group)
        out.append(sorted(group))
    return out


def compound_specifications(rows: DataFrame, key: str, reach: int = 300) -> DataFrame:
    """(key, seed, main_property, members, size, contexts, confidence, family, preservation) of groups of two and more.

    rows: key, start, end, property, value, category, confidence, context. The
    main property is that of the most confident member, the family the most
    frequent category, the first of those that are equal.
    """

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start", "end", "property", "value"], na_position="first").reset_index(drop=True)
        cell = lambda c: [None if pd.isna(x) else x for x in part[c]]
        starts, properties, categories, scores, contexts = map(cell, ("start", "property", "category", "confidence", "context"))
        out = []
        for group in groups_of(starts, categories, properties, reach):
            if len(group) > 1:
                mean = sum(scores[i] or 0.0 for i in group) / len(group)
                family = Counter(categories[i] for i in group).most_common(1)[0][0]
                best = max(group, key=lambda i: scores[i] or 0.0)
                keep = min(1.0, 0.8 + (0.1 if len(group) > 2 else 0.0) + mean * 0.1)
                out.append((part[key].iloc[0], group[0], properties[best], [properties[i] or "" for i in group], len(group), " | ".join(contexts[i] or "" for i in group), mean, family, keep))
        return pd.DataFrame(out, columns=[key, "seed", "main_property", "members", "size", "contexts", "confidence", "family", "preservation"])

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(key, "start", "end", "property", "value", "category", "confidence", "context")
    found = asked.groupBy(key).applyInPandas(build, f"{key} {kind}, seed int, main_property string, members array<string>, size int, contexts string, confidence double, family string, preservation double")
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "preservation")})
