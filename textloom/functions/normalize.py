"""Entity values in one spelling, by type, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms, unit spellings, genus names, nutrient symbols.
CHEMICALS = {"glyphosate": "N-(phosphonomethyl)glycine", "2,4-d": "2,4-dichlorophenoxyacetic acid", "urea": "carbamide", "potash": "potassium chloride", "muriate of potash": "potassium chloride"}
CROPS = {"corn": "maize", "zea mays": "maize", "soy": "soybean", "glycine max": "soybean", "wheat": "triticum aestivum"}
GENERA = {"z. mays": "zea mays", "t. aestivum": "triticum aestivum", "g. max": "glycine max", "s. lycopersicum": "solanum lycopersicum"}
UNITS = {
    "percent": "%",
    "pct": "%",
    "kg/hectare": "kg/ha",
    "kilogram per hectare": "kg/ha",
    "liters per hectare": "L/ha",
    "l/hectare": "L/ha",
    "mg/kg": "ppm",
    "milligrams per kilogram": "ppm",
}
NUTRIENTS = {
    "nitrogen": "N", "phosphorus": "P", "phosphorous": "P", "potassium": "K", "calcium": "Ca", "magnesium": "Mg", "sulfur": "S",
    "iron": "Fe", "manganese": "Mn", "zinc": "Zn", "copper": "Cu", "boron": "B", "molybdenum": "Mo",
}


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, text)


def _same(text: Column, table: dict[str, str], other: Column) -> Column:
    """The table's value for a text that is one of its keys."""
    return reduce(lambda c, kv: F.when(text == kv[0], kv[1]).otherwise(c), table.items(), other)


def titled(text: Column) -> Column:
    """Each run of letters capitalised; initcap() looks at blanks alone."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("\\p{L}+|\\P{L}+"), F.lit(0)), F.initcap), "")


def tidy(text: Column) -> Column:
    """Single blanks, and no full stops, commas, semicolons or colons at either end."""
    return F.btrim(F.btrim(F.regexp_replace(text, "\\s+", " ")), F.lit(".,;:"))


def product(text: Column) -> Column:
    """Separators as blanks, marks dropped; at most three words of letters and digits in capitals, else titled."""
    plain = F.upper(F.btrim(_chain(F.btrim(text), ("\\s+", " "), ("[-_]+", " "), ("\\s*[®™©]\\s*", ""))))
    plain = F.btrim(_chain(plain, ("℠", ""), ("[-_/\\\\]+", " "), ("\\s+", " ")))
    code = plain.rlike("^[A-Z0-9\\s-]+$") & (F.size(F.split(plain, " ")) <= 3)
    return F.when(code, plain).otherwise(titled(plain))


def chemical(text: Column) -> Column:
    """A known synonym's name, a registry number written one way, subscripts as digits; lower case."""
    plain = F.btrim(F.regexp_replace(text, "\\s+", " "))
    named = _same(F.lower(plain), CHEMICALS, plain)
    number = "(?i)(?:CAS\\s*[:#]?\\s*)?(\\d{2,7})-(\\d{2})-(\\d)(?:\\s*CAS)?"
    parts = [F.regexp_extract(named, number, i) for i in (1, 2, 3)]
    cas = F.when(F.length(parts[0]) > 0, F.concat(F.lit("CAS: "), F.concat_ws("-", *parts))).otherwise(named)
    return F.lower(F.translate(cas, "₀₁₂₃₄₅₆₇₈₉", "0123456789"))


def specification(text: Column) -> Column:
    """Units, percentages and pH written one way."""
    units = _chain(text, *[(f"(?i)\\b{k}\\b", v) for k, v in UNITS.items()])
    return _chain(units, ("(\\d+(?:\\.\\d+)?)\\s*%", "$1%"), ("(?i)pH\\s*[:=]?\\s*(\\d+(?:\\.\\d+)?)", "pH $1"))


def crop(text: Column) -> Column:
    low = F.btrim(F.lower(text))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), GENERA.items(), _same(low, CROPS, F.lower(text)))


def nutrient(text: Column) -> Column:
    """The symbol, in lower case, of the first listed name that the text holds."""
    low, other = F.lower(text), F.btrim(F.lower(text))
    return reduce(lambda c, kv: F.when(F.contains(low, F.lit(kv[0])), kv[1].lower()).otherwise(c), reversed(NUTRIENTS.items()), other)


def hazard(text: Column) -> Column:
    """Pictogram, hazard and precaution codes without blanks, in capitals."""
    return F.upper(_chain(text, ("(?i)GHS\\s*0?(\\d)", "GHS0$1"), ("(?i)([HP])\\s*(\\d{3})", "$1$2")))


BY_TYPE = {"PRODUCT": product, "CHEMICAL_COMPOUND": chemical, "SPECIFICATION": specification, "CROP": crop, "NUTRIENT": nutrient, "SAFETY_HAZARD": hazard}


def normalized(text: Column, kind: Column) -> Column:
    """By the entity's type, then tidied; other types are tidied alone. Null stays null."""
    return tidy(reduce(lambda c, kf: F.when(kind == kf[0], kf[1](text)).otherwise(c), BY_TYPE.items(), text))
