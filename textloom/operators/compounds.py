"""Specifications of foods and of general texts, and compound entities of a domain, with places.

Matches have places, which no column function gives, so they are found over Arrow
batches; all that is said of a match is native. Null and empty texts have no rows;
equal rows have equal results; a repeated key has the rows of each of its texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ladder
from textloom.operators.document_types import has_any

# Patterns of food specifications.
FOOD = {
    "nutritional_specification": r"(Protein|Fat|Carbohydrate|Fiber|Sugar|Sodium|Calories|Energy):\s*([0-9.,]+)\s*(g|mg|kcal|kJ|%)\s*(?:per\s+([0-9]+g|100g|serving))?",
    "microbiological_specification": r"(Total plate count|Total viable count|E\.?\s*coli|Salmonella|Listeria|Yeast and molds?|Yeast|Mold):\s*([0-9.,<>]+|Absent)\s*(CFU/g|CFU/ml|per gram|per 25g)?\s*(?:(max|maximum))?",
    "physical_specification": r"(pH|Water activity|Moisture|Viscosity|Density|Brix):\s*([0-9.,\-]+)(?:\s*[-–to]\s*([0-9.,\-]+))?\s*(?:([%°C\w/]+))?",
    "processing_specification": r"(Processing temperature|Cooking time|Pasteurization|Sterilization):\s*([0-9.,\-]+)\s*([°C°F\s]*)\s*(?:for\s+([0-9.,]+)\s*(minutes?|hours?|seconds?))?",
    "storage_specification": r"(Shelf life|Best before|Expiry|Storage):\s*([^.\n\r]{5,200})",
    "packaging_specification": r"(Net weight|Volume|Package size|Fill weight):\s*([0-9.,]+)\s*(g|kg|ml|L|oz|lb|fl oz)",
    "composition_specification": r"(Ingredients?):\s*([^.]{20,200})\s*(?:\(([^)]+)\))?",
    "allergen_specification": r"(Contains?|May contain|Allergens?|Free from):\s*([^.]{10,150})",
    "certification_specification": r"(Organic|Non-GMO|Gluten-free|Kosher|Halal|FDA approved|USDA certified|BRC|SQF|HACCP)\s*(?::\s*([^.]+))?",
    "sensory_specification": r"(Color|Taste|Texture|Appearance|Odor|Flavor):\s*([^.]{10,100})",
    "additive_specification": r"(Preservatives?|Additives?|E[0-9]+|BHA|BHT|Sorbic acid|Benzoic acid|Natural flavors?):\s*([^.]{5,100})",
}
# The class of each kind of food specification, and names that regulation concerns.
FOOD_CLASSES = [
    ("nutritional_information", ["nutritional_specification"]),
    ("food_safety", ["microbiological_specification"]),
    ("quality_parameter", ["physical_specification", "processing_specification"]),
    ("handling_requirement", ["storage_specification", "packaging_specification"]),
    ("regulatory_compliance", ["allergen_specification", "certification_specification"]),
    ("ingredient_information", ["composition_specification", "additive_specification"]),
    ("quality_attribute", ["sensory_specification"]),
]
REGULATED = ["salmonella", "e. coli", "listeria", "allergen", "fda", "usda", "organic"]
# Patterns of general specifications. Blanks before "=" and a number belong to the name, which is trimmed.
GENERAL = {
    "general_pattern_0": r"([A-Za-z\s]+):\s*([0-9.,\-]+(?:\s*to\s*[0-9.,\-]+)?)\s*([%°C\w/]+)(?:\s+(max|min|typical))?",
    "general_pattern_1": r"([A-Za-z\s]+)=\s*([0-9.,\-]+)\s*([%°C\w/]+)",
    "general_pattern_2": r"([A-Za-z\s]+)([0-9.,\-]+)\s*-\s*([0-9.,\-]+)\s*([%°C\w/]+)",
}
# Patterns of compound entities by domain, as (type, pattern), and the confidence of each domain.
COMPOUNDS = {
    "pharmaceutical": [
        ("ph_specification", r"(pH):\s*([0-9.,\-]+)(?:\s*[-–to]\s*([0-9.,\-]+))?\s*(?:\(([^)]+)\))?"),
        ("moisture_specification", r"(Loss on drying):\s*([0-9.,]+)%?\s*(max|maximum|typical)?\s*(?:at\s+([0-9°C\s]+))?"),
        ("density_specification", r"(Bulk density|Tapped density):\s*([0-9.,\-]+)(?:\s*[-–to]\s*([0-9.,\-]+))?\s*(g/cm³|g/ml)"),
        ("particle_size", r"(Particle size)\s*(?:\([^)]+\))?\s*:\s*([0-9.,\-]+)(?:\s*[-–to]\s*([0-9.,\-]+))?\s*(μm|microns)"),
        ("composition", r"Composition:\s*(\d+%)\s+([A-Za-z\s]+)\s*\+\s*(\d+%)\s+([A-Za-z\s\d]+)"),
        ("impurity_specification", r"(Heavy metals):\s*([0-9.,]+)\s*(ppm|mg/kg)\s*(max|maximum)?"),
        ("microbial_specification", r"(Total aerobic count):\s*([0-9.,]+)\s*(CFU/g)\s*(max|maximum)?"),
        ("assay_specification", r"(Assay):\s*([0-9.,\-]+%?)(?:\s+\([^)]+\))?"),
    ],
    "legal": [
        ("condition", r"(shall|must|may)\s+([^.]{10,150}?)(?:\s+(provided that|unless|except|within))"),
        ("obligation", r"(Licensee|Party|Licensor|Company)\s+(shall|must|will|agrees to)\s+([^.]{15,150})"),
        ("liability", r"(Liability|liable|responsible|damages?)\s+(?:shall\s+)?(?:not\s+)?(?:exceed|for)\s+([^.]{10,100})"),
        ("time_requirement", r"(within\s+\d+\s+days?|before|after)\s+(?:of\s+)?([^.]{10,80})"),
        ("performance_requirement", r"(Performance|standards?|requirements?)\s+(?:shall\s+)?(?:be\s+)?(?:maintained\s+)?(?:at\s+)?([^.]{10,100})"),
        ("financial_specification", r"(\$[\d,]+(?:\.\d{2})?)\s+([^.]{5,50})"),
        ("definition", r'"([^"]+)"\s+means\s+([^.]+)'),
    ],
    "food_industry": [
        ("nutritional_specification", FOOD["nutritional_specification"]),
        ("ingredient_composition", FOOD["composition_specification"]),
        ("shelf_life_specification", r"(Shelf life|Best before|Expiry):\s*([0-9]+)\s*(days?|months?|years?)\s*(?:from\s+([^.]+))?"),
        ("storage_condition", r"(Storage|Store|Keep)\s+(?:at\s+)?([^.]{10,80})\s*(?:at\s+([0-9\-°C\s]+))?"),
        ("microbiological_standard", FOOD["microbiological_specification"]),
        ("allergen_information", r"(Contains?|May contain|Allergens?):\s*([^.]{10,150})"),
        ("physical_property", r"(pH|Water activity|Moisture|Viscosity|Density):\s*([0-9.,\-]+)(?:\s*[-–to]\s*([0-9.,\-]+))?\s*(?:([%°C\w/]+))?"),
        ("processing_parameter", r"(Processing temperature|Cooking time|Pasteurization):\s*([0-9.,\-]+)\s*([°C°F\s]*)\s*(?:for\s+([0-9.,]+)\s*(minutes?|hours?|seconds?))?"),
        ("packaging_specification", r"(Net weight|Volume|Package size):\s*([0-9.,]+)\s*(g|kg|ml|L|oz|lb)"),
        ("quality_certification", r"(Organic|Non-GMO|Gluten-free|Kosher|Halal|FDA approved|USDA certified)\s*(?::\s*([^.]+))?"),
        ("chemical_additive", r"(Preservatives?|Additives?|E[0-9]+|BHA|BHT|Sorbic acid|Benzoic acid):\s*([^.]{5,100})"),
        ("serving_specification", r"(Serving size|Portion):\s*([0-9.,]+)\s*(g|ml|cups?|pieces?|slices?)"),
    ],
    "agricultural": [
        ("application", r"(?:Application rate:\s*)?(\d+(?:\.\d+)?)\s*(kg/ha|L/ha|g/L)\s+(?:of\s+)?([A-Za-z\s]+)(?:\s+(?:on|for)\s+([A-Za-z\s]+))?"),
        ("efficacy", r"(?:Efficacy:\s*)?(?:Product\s+)?([A-Za-z\s]*)\s*(?:increases|improves|reduces)\s+([A-Za-z\s]+)\s+by\s+(\d+(?:\.\d+)?%)"),
        ("composition", r"(?:Chemical composition:\s*)?([A-Za-z\s]+)\s*(?:\(|:)\s*(\d+(?:\.\d+)?%)\s+([A-Za-z\s]+)(?:\)|$)"),
        ("safety", r"(?:Safety interval:\s*)?(\d+)\s*(days?|hours?)\s+(?:before|after)\s+([A-Za-z\s]+)(?:\s+for\s+([A-Za-z\s]+))?"),
        ("efficacy", r"(?:Efficacy|Effect):\s*([^.]{10,100})"),
        ("application", r"(?:Apply|Application):\s*([^.]{10,100})"),
    ],
    "general": [
        ("measurement_range", r"([A-Za-z\s]+):\s*([0-9.,\-]+)\s*(?:to|-)\s*([0-9.,\-]+)\s*([%°C\w/]+)"),
        ("single_measurement", r"([A-Za-z\s]+):\s*([0-9.,\-]+)\s*([%°C\w/]+)(?:\s+(max|min|typical))?"),
        ("composition", r"(\d+%)\s+([A-Za-z\s]+)(?:\s*\+\s*(\d+%)\s+([A-Za-z\s]+))?"),
        ("grade_spec", r"([A-Za-z\s]+)\s+(grade|type|class)\s+([A-Za-z0-9\s]+)"),
    ],
}
CONFIDENCE = {"pharmaceutical": 0.9, "legal": 0.8, "food_industry": 0.9, "agricultural": 0.85, "general": 0.9}
# Words that tell what a compound speaks of.
LEVELS = [
    ("technical_specification", ["specification", "property", "characteristic"]),
    ("chemical_composition", ["composition", "formula", "mixture"]),
    ("application_method", ["application", "use", "method"]),
    ("safety_information", ["safety", "hazard", "warning"]),
]

#: A pattern that opens with such a run, maybe after a label, can begin at the run's first place or at the label alone.
_RUNS = {r"([A-Za-z\s]+": r"[A-Za-z\s]+", r"([A-Za-z\s]*": r"[A-Za-z\s]+"}
PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?$"


@lru_cache(maxsize=None)
def _starts(pattern: str) -> re.Pattern | None:
    """Where a pattern that opens with a run of letters can begin; None for others, whose starts are few."""
    label = re.match(r"\(\?:([A-Za-z ]+:)\\s\*\)\?(?:\(\?:Product\\s\+\)\?)?", pattern)
    body = pattern[label.end() :] if label else pattern
    run = next((r for opens, r in _RUNS.items() if body.startswith(opens)), None)
    return run and re.compile(f"{label[1]}|{run}" if label else run, re.I)


@lru_cache(maxsize=None)
def _needed(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match holds one; none where that isn't plain from the pattern."""
    group = re.match(r"\((?:\?:)?([^()]*)\)(?!\?)(.?)", pattern)
    if not group:
        return ()
    if group[1].startswith("[A-Za-z"):
        return (group[2],) if group[2] in ":=" else ()
    parts = [re.split(r".\?|\\.|\[[^\]]*\]|[*+?]", way) for way in group[1].split("|")]
    found = tuple(max(p, key=len).lower() for p in parts)
    return found if all(found) else ()


#: Letters that patterns without case take for others, though their lower case differs.
_ODD = ("\u017f", "\u0130", "\u0131")


def matches(pattern: str, text: str, low: str | None = None) -> Iterator[re.Match]:
    """What finditer gives without case, but a run of letters is tried from its first place only.

    low is the text in lower case: a text without any literal that the pattern needs isn't searched.

    What fails there fails at every later place of the run, as that place has
    fewer ways on; a label inside a run is one more place to begin.
    """
    needed = _needed(pattern)
    if low is not None and needed and not any(w in low for w in needed) and not any(c in text for c in _ODD):
        return
    starts = _starts(pattern)
    if starts is None:
        yield from re.finditer(pattern, text, re.I)
        return
    whole, label = re.compile(pattern, re.I), re.match(r"\(\?:([A-Za-z ]+:)", pattern)
    labelled = label and re.compile(re.escape(label[1]), re.I)
    at = 0
    while run := starts.search(text, at):
        m = whole.match(text, run.start())
        if not m and labelled:
            for inner in labelled.finditer(text, run.start() + 1, run.end() + 1):
                if m := whole.match(text, inner.start()):
                    break
        if m:
            yield m
        at = max(m.end(), run.start() + 1) if m else run.end()


def spans(docs: DataFrame, key: str, text: str, patterns: list[tuple[str, str]], reach: int) -> DataFrame:
    """(key, place, kind, start, end, value, groups, context): matches pattern by pattern, place counts them within a text, absent groups are empty."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "place", "kind", "start", "end", "said", "groups", "context"]

    def run(batches, most=4096):
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
            packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), types)], names=names)
            rows = []
            for k, t in zip(*[c.to_pylist() for c in batch.columns]):
                low = t.lower()
                found = ((name, m) for name, p in patterns for m in matches(p, t, low))
                for i, (n, m) in enumerate(found):
                    rows.append((k, i, n, m.start(), m.end(), m[0], [g or "" for g in m.groups()], t[max(0, m.start() - reach) : m.end() + reach].strip()))
                    if len(rows) == most:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    return docs.select(key, text).where(F.length(text) > 0).mapInArrow(run, f"{key} {kind}, place long, kind string, start long, end long, said string, groups array<string>, context string")


def _group(i: int) -> Column:
    return F.coalesce(F.get("groups", F.lit(i)), F.lit(""))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _score(base: float, *points: tuple[Column, float]) -> Column:
    return F.round(F.least(F.lit(1.0), sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(base))), 6)


def food_specifications(docs: DataFrame, key: str, text: str, reach: int = 100) -> DataFrame:
    """One row per food specification: places, property, value, unit, qualifier, context, class, limit, range, regulated, confidence."""
    kind, unit, name, value = F.col("kind"), _group(2), _trimmed(_group(0)), _trimmed(_group(1))
    dated = (kind == "storage_specification") & has_any(name, ["shelf", "expiry", "before"])
    term = r"([0-9]+)\s*(days?|months?|years?)"
    timed = dated & value.rlike(term)
    whole = kind.isin("composition_specification", "allergen_specification", "certification_specification", "sensory_specification", "additive_specification")
    found = spans(docs, key, text, list(FOOD.items()), reach).select(
        key, "kind", "start", "end", name.alias("property"),
        F.when(timed, F.regexp_extract(value, term, 1)).when((kind == "physical_specification") & (unit != ""), F.concat(value, F.lit("-"), unit)).when(whole, _group(1)).otherwise(value).alias("value"),
        F.when(kind == "physical_specification", _group(3)).when(timed, F.regexp_extract(value, term, 2)).when(dated, "specification").when(kind == "storage_specification", "storage condition")
        .when((kind == "processing_specification") & (unit == ""), "°C").when(kind == "composition_specification", "ingredient list").when(whole, "specification").otherwise(unit).alias("unit"),
        F.when((kind == "nutritional_specification") & (_group(3) == ""), "per 100g").when(kind.isin("nutritional_specification", "microbiological_specification"), _group(3))
        .when((kind == "processing_specification") & (_group(3) != ""), F.concat(F.lit("for "), _group(3), F.lit(" "), _group(4))).when(kind == "composition_specification", unit).otherwise("").alias("qualifier"),
        "context",
    )
    measured, declared = kind.isin("nutritional_specification", "microbiological_specification"), kind.isin("allergen_specification", "certification_specification")
    return found.select(
        "*", ladder("general_food_spec", *[(kind.isin(*kinds), c) for c, kinds in FOOD_CLASSES]).alias("category"),
        has_any(F.col("qualifier"), ["max", "min"]).alias("has_limit"), has_any(F.col("value"), ["-", "to"]).alias("has_range"),
        (declared | (kind == "microbiological_specification") | has_any(F.col("property"), REGULATED)).alias("regulated"),
        _score(0.7, (measured, 0.2), (declared, 0.15), (F.col("value").rlike(PLAIN_NUMBER), 0.1), ((F.col("unit") != "") & (F.col("unit") != "specification"), 0.05)).alias("confidence"),
    )


def general_specifications(docs: DataFrame, key: str, text: str, reach: int = 50) -> DataFrame:
    """One row per specification of any text. Of a range the unit column holds its end and the qualifier its unit."""
    name, value, unit = _trimmed(_group(0)), _trimmed(_group(1)), _trimmed(_group(2))
    score = _score(0.5, (F.length(name) > 2, 0.2), (value.rlike(PLAIN_NUMBER), 0.2), (unit != "", 0.1))
    return spans(docs, key, text, list(GENERAL.items()), reach).select(key, "kind", "start", "end", name.alias("property"), value.alias("value"), unit.alias("unit"), _group(3).alias("qualifier"), "context", score.alias("confidence"))


def compound_entities(docs: DataFrame, key: str, text: str, domain: str = "general") -> DataFrame:
    """One row per compound of a domain, an unknown one taking the general patterns: id, value, type, places, parts, level and properties.

    Parts are the groups of the match: those that begin with letters or blanks
    first, trimmed, then those that begin with a digit, with their place.
    """
    known = domain if domain in COMPOUNDS else "general"
    said, parts = F.col("said"), F.filter("groups", lambda g: g != "")
    placed = F.transform(parts, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    part = lambda kind, value, role: F.struct(kind.alias("type"), value.alias("value"), role.alias("role"))
    named = F.transform(F.filter(parts, lambda g: g.rlike(r"(?U)^[A-Za-z\s]")), lambda g: part(F.lit("sub_concept"), _trimmed(g), F.lit("component")))
    numbers = F.transform(F.filter(placed, lambda p: p["g"].rlike(r"(?U)^\d")), lambda p: part(F.lit("attribute"), p["g"], F.concat(F.lit("value_"), p["i"].cast("string"))))
    return spans(docs, key, text, COMPOUNDS[known], 0).select(
        key, F.concat(F.lit(f"compound_{domain}_"), F.col("place").cast("string")).alias("id"), said.alias("value"), F.col("kind").alias("entity_type"), F.lit(domain).alias("domain"),
        F.lit(CONFIDENCE[known]).alias("confidence"), "start", "end", F.concat(named, numbers).alias("components"), ladder("general_entity", *[(has_any(said, w), n) for n, w in LEVELS]).alias("level"),
        said.rlike(r"(?U)\d+(?:\.\d+)?\s*[%°C\w/]+").alias("has_measurements"), said.rlike(r"(?U)\d+(?:\.\d+)?%").alias("has_percentages"), F.size(parts).alias("complexity"),
    )
