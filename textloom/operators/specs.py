"""Technical, nutritional, allergen, regulatory and storage facts of texts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ladder

# Patterns of food facts.
VITAMIN = r"(?i)\bvitamin\s+([A-K]\d*)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*([μmg/IU]+)"
MINERAL = r"(?i)\b(calcium|iron|zinc|magnesium|potassium)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mg|g|%)"
CALORIES = r"(?i)\b(\d+(?:\.\d+)?)\s*(cal|kcal|kJ)(?:/(?:100)?g)?\b"
E_NUMBER = r"(?i)\bE\s*(\d{3,4})\b"
INS_NUMBER = r"(?i)\bINS\s*(\d{3,4})\b"
GRAS = r"(?i)\bGRAS\b"
DECLARED = r"(?i)\b(?:contains?|may contain)\s+([^.]+)"
FREE_FROM = r"(?i)\b(gluten|dairy|nut|soy|egg|fish|shellfish)-free\b"
CERTIFIED = r"(?i)\b(kosher|halal|organic|non-gmo)\s+certified\b"
SCHEMES = r"(?i)\b(haccp|brc|sqf|ifs|fssc)\s"
STORAGE = {"refrigerated": r"(?i)\brefrigerat", "frozen": r"(?i)\bfreez", "dry storage": r"(?i)\bdry\s+place\b", "light-protected": r"(?i)\bprotect\s+from\s+light\b"}

# The run of letters before "impurity" may begin at its first letter alone, so that it is read once.
# Patterns of laboratory specifications, each as property, value, end of a range, unit, qualifier (0: none).
SPECIFICATIONS = {
    "ph_specification": (r"(pH):\s*([0-9.,]+)(?:\s*[-–to]\s*([0-9.,]+))?\s*(?:\(([^)]+)\))?", 1, 2, 3, 0, 4),
    "moisture_specification": (r"(Loss on drying|Moisture content|Water content):\s*([0-9.,]+)%?\s*(max|maximum|typical|NMT)?\s*(?:at\s+([0-9°C\s]+))?", 1, 2, 0, 0, 3),
    "density_specification": (r"(Bulk density|Tapped density|Apparent density):\s*([0-9.,]+)(?:\s*[-–to]\s*([0-9.,]+))?\s*(g/cm³|g/ml|kg/m³)", 1, 2, 3, 4, 0),
    "particle_size": (r"(Particle size|D50|D90|Mean particle size):\s*([0-9.,]+)(?:\s*[-–to]\s*([0-9.,]+))?\s*(μm|microns|nm)\s*(?:\(([^)]+)\))?", 1, 2, 3, 4, 5),
    "assay_specification": (r"(Assay|Content|Purity):\s*([0-9.,]+)(?:\s*[-–to]\s*([0-9.,]+))?\s*%?\s*(w/w|w/v|on dry basis)?", 1, 2, 3, 4, 0),
    "impurity_specification": (r"(Heavy metals|Residual solvents|(?<![A-Za-z\s])[A-Za-z\s]+impurities?):\s*([0-9.,]+)\s*(ppm|ppb|mg/kg|%)\s*(max|maximum|NMT)?", 1, 2, 0, 3, 4),
    "microbial_specification": (r"(Total aerobic count|Yeast and molds|E\. coli|Salmonella):\s*([0-9.,]+|Absent)\s*(CFU/g|per gram)?", 1, 2, 0, 3, 0),
}
#: What every specification has: one of the names, a colon and the start of a value. Texts without are passed over.
NAMED = (
    r"(?i)(?:pH|Loss on drying|Moisture content|Water content|density|size|D50|D90|Assay|Content|Purity|Heavy metals|Residual solvents|impurities?"
    r"|Total aerobic count|Yeast and molds|E\. coli|Salmonella):\s*(?:[0-9.,]|Absent)"
)
#: Words of a property name, and the category they tell (fixed values).
CATEGORIES = [
    ("chemical_property", ["ph"]),
    ("physical_property", ["moisture", "loss", "water", "density", "bulk", "tapped"]),
    ("particle_property", ["particle", "size", "d50", "d90"]),
    ("chemical_property", ["assay", "content", "purity"]),
    ("impurity_property", ["heavy", "metal", "impurity"]),
    ("microbiological_property", ["microbial", "bacteria", "yeast"]),
]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _amounts(text: Column, pattern: str) -> Column:
    """(name, amount, unit) of every match, in text order."""
    rows = F.arrays_zip(_all(text, pattern, 1).alias("name"), _all(text, pattern, 2).alias("amount"), _all(text, pattern, 3).alias("unit"))
    return F.transform(rows, lambda r: F.struct(r["name"].alias("name"), r["amount"].cast("double").alias("amount"), r["unit"].alias("unit")))


def nutrition(text: Column) -> Column:
    """vitamins, minerals, and the first energy value (null without any)."""
    amount = F.regexp_extract(text, CALORIES, 1)
    energy = F.when(F.length(amount) > 0, F.struct(amount.cast("double").alias("amount"), F.regexp_extract(text, CALORIES, 2).alias("unit")))
    return F.struct(_amounts(text, VITAMIN).alias("vitamins"), _amounts(text, MINERAL).alias("minerals"), energy.alias("energy"))


def allergens(text: Column) -> Column:
    """contains, may_contain, free_from: declarations count as possible where the text says "may contain" anywhere."""
    listed = F.flatten(F.transform(_all(text, DECLARED), lambda d: F.transform(F.split(d, ","), lambda x: F.btrim(x))))
    possible, none = F.contains(F.lower(text), F.lit("may contain")), F.array().cast("array<string>")
    return F.struct(
        F.when(possible, none).otherwise(listed).alias("contains"),
        F.when(possible, listed).otherwise(none).alias("may_contain"),
        F.array_sort(F.array_distinct(_all(text, FREE_FROM))).alias("free_from"),
    )


def food_regulation(text: Column) -> Column:
    return F.struct(
        text.rlike(GRAS).alias("gras"),
        text.rlike(r"(?i)\bfda\s+approved\b").alias("fda_approved"),
        text.rlike(r"(?i)\befsa\s+approved\b").alias("efsa_approved"),
        F.transform(_all(text, E_NUMBER), lambda n: F.concat(F.lit("E"), n)).alias("e_numbers"),
        F.transform(_all(text, INS_NUMBER), lambda n: F.concat(F.lit("INS"), n)).alias("ins_numbers"),
        F.concat(_all(text, CERTIFIED), _all(text, SCHEMES)).alias("certifications"),
    )


def storage_conditions(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in STORAGE.items()]))


def _category(name: Column) -> Column:
    low = F.lower(name)
    return ladder("general_property", *[(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), kind) for kind, words in CATEGORIES])


def specifications(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per specification: kind, property, value, range_end, unit, qualifier, category, confidence.

    Confidence grows with what is stated: a telling name, a plain number, a unit
    and a qualifier. Missing parts are empty strings; a null text has no rows.
    """
    parts = ("property", "value", "range_end", "unit", "qualifier")

    def of(kind: str) -> Column:
        pattern, *groups = SPECIFICATIONS[kind]
        whole = _all(F.col(text), f"(?i){pattern}", 0)
        found = [_all(F.col(text), f"(?i){pattern}", g) if g else F.transform(whole, lambda w: F.lit("")) for g in groups]
        rows = F.arrays_zip(*[f.alias(n) for f, n in zip(found, parts)])
        return F.transform(rows, lambda r: F.struct(F.lit(kind).alias("kind"), *[F.btrim(F.coalesce(r[n], F.lit(""))).alias(n) for n in parts]))

    named = docs.where(F.col(text).rlike(NAMED))
    each = named.select(key, F.explode(F.concat(*[of(k) for k in SPECIFICATIONS])).alias("s")).select(key, "s.*")
    low = F.lower("property")
    told = F.exists(F.array(*map(F.lit, ("ph", "moisture", "density", "size", "assay"))), lambda w: F.contains(low, w))
    points = [(F.length("property") > 2, 0.2), (told, 0.1), (F.col("value").rlike(r"^\d+(?:\.\d+)?$"), 0.2), (F.col("unit") != "", 0.15), (F.col("qualifier") != "", 0.05)]
    confidence = F.least(F.lit(1.0), sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(0.5)))
    return each.withColumn("category", _category(F.col("property"))).withColumn("confidence", F.round(confidence, 6))
