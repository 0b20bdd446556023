"""Whether an entity is worth keeping: scores of its meaning, length, context and language, by its type, and compounds marked.

Patterns are stated once and made for Java's or SQL's expressions as in entity_language.

Defined results: null values, types, contexts, document types and languages are
empty ones, null confidences are none; a value of any length is scored whole,
in time about linear in its length; repeated rows count each; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import entity_language as language
from textloom.operators.entity_language import SPACE
from textloom.operators.measures import estimated

#: What speaks for an entity of a type, from the start of its value and whatever its case, with the bonus (fixed values).
MEANINGFUL = {
    "CHEMICAL_COMPOUND": (
        0.3,
        [
            r"\b[A-Z][a-z]*(?:[A-Z][a-z]*)*(?:\s+\d+)?(?:\s*[®™])?$",
            r"\b\w+(?:\s+\w+){0,3}(?:\s+(?:acid|oxide|hydroxide|sulfate|chloride|nitrate|glycolate))$",
            r"\b(?:sodium|potassium|calcium|magnesium|aluminum)\s+\w+(?:\s+\w+)?$",
            r"\b\w*(?:amine|phenol|benzene|methyl|ethyl|propyl|starch)\w*$",
            r"\b(?:acide|oxyde|hydroxyde|sulfate|chlorure|nitrate|glycolate)\s+\w+$",
            r"\b(?:sodium|potassium|calcium|magnésium|aluminium)\s+\w+(?:\s+\w+)?$",
        ],
    ),
    "PRODUCT": (
        0.25,
        [
            r"\b[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*(?:\s*[®™])?$",
            r"\b\w+(?:\s+\w+){0,2}(?:\s+(?:powder|tablet|solution|gel|cream|poudre|comprimé|solution))$",
            r"\b[A-Z]{2,}(?:\s*\d+)?(?:\s*[®™])?$",
            r"\bLYCATAB(?:\s*®)?(?:\s+[A-Z]+)?$",
            r"\bPEARLITOL(?:\s*®)?(?:\s+[A-Z]+)?$",
            r"\b[A-Z]{3,}(?:\s*[®™])?(?:\s+[A-Z0-9]+)?$",
            r"\b[A-Z]+\s*\d+(?:[A-Z]+)?$",
            r"\b\w+\s*-\s*\w+(?:\s*-\s*\w+)?$",
        ],
    ),
    "SPECIFICATION": (
        0.35,
        [
            r"\b\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?\s*(?:%|ppm|mg|kg|°C|pH|μm)$",
            r"\bpH\s*:?\s*\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?$",
            r"\b(?:max|min|typical|nominal|maximum|minimum)\s+\d+(?:\.\d+)?(?:\s*%)?$",
            r"\b(?:maximum|minimum|typique|nominal)\s+\d+(?:\.\d+)?(?:\s*%)?$",
            r"\b\d+(?:\.\d+)?\s*(?:g/cm³|kg/m³|μm|nm)$",
        ],
    ),
    "APPLICATION": (
        0.25,
        [
            r"\b\w+(?:\s+\w+){1,4}(?:\s+(?:application|use|purpose|utilisation|usage))$",
            r"\b(?:used|suitable|recommended|intended|utilisé|approprié|recommandé)\s+(?:for|as|in|pour|comme|dans)\s+\w+$",
        ],
    ),
}
#: What speaks against an entity of any type, in its trimmed lower case, with the loss (fixed values).
NOISE = {
    "sentence_fragments": (
        0.4,
        [
            r"^(?:and|or|but|the|of|in|on|at|to|for|with|by|from)\b",
            r"^(?:is|are|was|were|be|been|being|have|has|had|will|would|could|should)\b",
            r"^(?:this|that|these|those|it|they|we|you|he|she)\b",
            r"\b(?:is|are|was|were)\s+a\s+\w+$",
            r"\b(?:can|may|must|shall|will|would)\s+be\b",
            r"\b(?:used|suitable|recommended)\s+for$",
            r"\b(?:and|or)\s+\w+(?:\s+\w+)?$",
            r"^\w+(?:\s+\w+)?\s+(?:of|in|on|at|to|for|with|by|from)$",
            r"^(?:et|ou|mais|le|la|les|de|du|des|dans|sur|avec|pour|par)\b",
            r"^(?:est|sont|était|étaient|être|avoir|avait|peut|doit|va|aller)\b",
            r"^(?:ce|cette|ces|ceux|il|elle|ils|elles|nous|vous)\b",
            r"\b(?:est|sont)\s+(?:un|une)\s+\w+$",
            r"\b(?:peut|doit|va|aller)\s+être\b",
            r"\b(?:utilisé|approprié|recommandé)\s+pour$",
            r"\b(?:et|ou)\s+\w+(?:\s+\w+)?$",
            r"^\w+(?:\s+\w+)?\s+(?:de|du|des|dans|sur|avec|pour|par)$",
            r"^(?:dans la|de la|des produits|avec de|pour la|sur la)\b",
            r"^(?:apporter en|obtenir des|laver avec|contact avec|mesures de)\b",
            r"^(?:informations sur|classification selon|limite de|niveau important)\b",
            r"^(?:bottes en|division of|bibliographiques et|bioaccumulable et)\b",
            r"^(?:en cas d|en cas de|en suspension dans)\b",
        ],
    ),
    "incomplete_specifications": (
        0.5,
        [
            r"^\d+$",
            r"^[A-Z]$",
            r"^\w{1,2}$",
            r"^(?:max|min|typical|nominal|maximum|minimum|typique)$",
            r"^(?:%|ppm|mg|kg|°C|pH|μm|g/cm³)$",
            r"^\s*[-–:(),.;]\s*$",
        ],
    ),
    "generic_terms": (
        0.3,
        [
            r"^(?:product|ingredient|component|element|substance|material|compound)$",
            r"^(?:property|characteristic|feature|aspect|quality)$",
            r"^(?:information|data|details|description|specification)$",
            r"^(?:content|level|amount|quantity|concentration)$",
            r"^(?:value|number|figure|result|measurement)$",
            r"^(?:produit|ingrédient|composant|élément|substance|matériau|composé)$",
            r"^(?:propriété|caractéristique|aspect|qualité)$",
            r"^(?:information|données|détails|description|spécification)$",
            r"^(?:contenu|niveau|quantité|concentration)$",
            r"^(?:valeur|nombre|résultat|mesure)$",
        ],
    ),
    "document_artifacts": (
        0.4,
        [
            r"^(?:page|section|chapter|part|table|figure|appendix)\s*\d*$",
            r"^(?:see|refer|reference|note|footnote|remark)$",
            r"^(?:above|below|following|preceding|next|previous)$",
            r"^(?:continued|end|start|begin|conclusion)$",
            r"^(?:page|section|chapitre|partie|tableau|figure|annexe)\s*\d*$",
            r"^(?:voir|référer|référence|note|remarque)$",
            r"^(?:ci-dessus|ci-dessous|suivant|précédent|prochain|précédente)$",
            r"^(?:continué|fin|début|commencer|conclusion)$",
            r"^(?:FDS|CLP|Annex|VIII)$",
            r"^(?:American Chemical Society|Chemical Abstracts Service)$",
        ],
    ),
}
#: Words at the end that leave a phrase open: English, French; each costs 0.3 (fixed values).
OPEN_ENDS = [r"\b(?:and|or|of|in|on|at|to|for|with|by|from|is|are|was|were)$", r"\b(?:et|ou|de|du|des|dans|sur|avec|pour|par|est|sont|était|étaient)$"]
#: Compounds to be kept whole, first match first (fixed values).
COMPOUNDS = [
    r"[A-Z][a-z]+®?\s+[A-Z][A-Z0-9]*(?:\s*-\s*[A-Z0-9]+)?",
    r"LYCATAB(?:\s*®)?\s*(?:PGS|CR|H)?(?:\s*-\s*[A-Z0-9]+)?",
    r"PEARLITOL(?:\s*®)?\s*(?:CR|H|SD)?(?:\s*-\s*[A-Z0-9]+)?",
    r"NPK\s+\d+-\d+-\d+",
    r"pH\s+\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?",
    r"\d+(?:\.\d+)?%\s*w/w",
    r"\d+(?:\.\d+)?\s*(?:kg|g|mg)/ha",
    r"Loss\s+on\s+drying:\s*\d+(?:\.\d+)?%?",
    r"Perte\s+(?:à|au)\s+séchage:\s*\d+(?:\.\d+)?%?",
    r"Bulk\s+density:\s*\d+(?:\.\d+)?\s*g/cm³",
    r"Densité\s+(?:apparente|en\s+vrac):\s*\d+(?:\.\d+)?\s*g/cm³",
    r"Particle\s+size:\s*\d+(?:\.\d+)?\s*μm",
    r"Taille\s+(?:des\s+)?particules:\s*\d+(?:\.\d+)?\s*μm",
    r"Moisture\s+content:\s*\d+(?:\.\d+)?%?",
    r"Teneur\s+en\s+(?:eau|humidité):\s*\d+(?:\.\d+)?%?",
    r"CAS\s+No\.?\s*\d+-\d+-\d+",
    r"N°\s*CAS\s*\d+-\d+-\d+",
    r"E\s*\d{3,4}(?:\s*[a-z])?",
    r"INS\s*\d{3,4}",
    r"EC\s+No\.?\s*\d+-\d+-\d+",
    r"N°\s*CE\s*\d+-\d+-\d+",
    r"[A-Z]+\s*\d{6,}(?:[A-Z]+)?",
    r"EXP_\d{12}",
    r"SDS\s*[A-Z]{2}\s*[A-Z0-9_]+",
    r"FDS\s*[A-Z]{2}\s*[A-Z0-9_]+",
    r"[A-Z]{3,}(?:\s*®|\s*™)(?:\s+[A-Z0-9]+)?",
    r"sodium\s+starch\s+glycolate(?:\s*[®™])?",
    r"glycolate\s+d'amidon\s+sodique(?:\s*[®™])?",
]
#: Words of a context that go with a document type, and words of page furniture (fixed values).
INDICATORS = {
    "sds": ["safety", "hazard", "chemical", "composition", "identification"],
    "technical": ["specification", "property", "parameter", "value", "range"],
    "agricultural": ["crop", "yield", "application", "fertilizer", "nutrient"],
    "food": ["ingredient", "additive", "nutrition", "allergen", "processing"],
}
FURNITURE = ["page", "header", "footer", "copyright"]
#: Weights of the scores, and the least confidence, meaning and total (fixed values).
WEIGHTS = {"confidence": 0.3, "semantic": 0.25, "length": 0.15, "context": 0.2, "language": 0.1}
LEAST = {"confidence": 0.4, "semantic": 0.5, "final": 0.45}


def whole(pattern: str) -> str:
    """The pattern from the start of a value: its first border says nothing there, and repeats inside repeats are one class of letters."""
    once = pattern.replace(r"[A-Z][a-z]*(?:[A-Z][a-z]*)*", "[A-Z]+").replace(r"[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*", r"[A-Z](?:[A-Z\s]*[A-Z])?")
    return ended("^" + re.sub(r"^(\\b|\^)", "", once))


def ended(pattern: str) -> str:
    """An end that lets one line feed follow, as the patterns mean it."""
    return re.sub(r"\$$", r"\\n?\\z", pattern)


def anywhere(pattern: str) -> str:
    """The pattern's test alone: what comes before a run's last letter needn't be searched."""
    return re.sub(r"^\[A-Z\]\{3,\}", "[A-Z]{3}", re.sub(r"^\[A-Z\]\+", "[A-Z]", pattern))


def _words(value: Column) -> Column:
    return F.regexp_count(value, F.lit(f"[^{SPACE[1:-1]}]+"))


def semantic_score(value: Column, kind: Column) -> Column:
    """From 0 to 1: a bonus for what is usual for the type, losses for fragments, generic words, furniture and open ends."""
    value, kind = F.coalesce(value, F.lit("")), F.upper(F.coalesce(kind, F.lit("")))
    low = language.stripped(F.lower(value))
    points = [((kind == k) & language.any_of(value, [whole(p) for p in patterns], True), bonus) for k, (bonus, patterns) in MEANINGFUL.items()]
    points += [(language.any_of(low, [ended(p) for p in patterns]), -loss) for loss, patterns in NOISE.values()]
    points += [((kind == "CHEMICAL_COMPOUND") & (language.chemical_validity(value) < 0.3), -0.3), (_words(value) > 8, -0.2)]
    points += [(F.length(value) - F.length(F.replace(value, F.lit(" "), F.lit(""))) > 6, -0.2)]
    points += [(language.any_of(F.right(low, F.lit(20)), [p]), -0.3) for p in OPEN_ENDS]  # longer than any of the words and what borders it
    score = sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(0.5))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def length_score(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    n, w = F.length(language.stripped(value)), _words(value)
    return F.when(value == "", 0.0).when(n < 2, 0.1).when(w > 6, 0.3).when(n.between(3, 30) & (w <= 4), 1.0).when(n <= 50, 0.8).otherwise(0.6)


def context_score(value: Column, context: Column, document_type: Column) -> Column:
    """0.6 without a context; else more for words of the document's type and for the value itself, less for page furniture."""
    low, kind = F.lower(context), F.lower(F.coalesce(document_type, F.lit("")))
    score = F.lit(0.5)
    for k, words in INDICATORS.items():
        hits = sum((F.when(F.contains(low, F.lit(w)), 0.1).otherwise(0.0) for w in words), F.lit(0.0))
        score = score + F.when(kind == k, hits).otherwise(0.0)
    score = score + F.when(F.contains(low, F.lower(F.coalesce(value, F.lit("")))), 0.2).otherwise(0.0)
    noise = F.exists(F.array(*map(F.lit, FURNITURE)), lambda w: F.contains(low, w))
    score = score - F.when(noise, 0.3).otherwise(0.0)
    return F.when(F.coalesce(context, F.lit("")) == "", 0.6).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def compound_pattern(value: Column) -> Column:
    """The first of COMPOUNDS that the value holds, null if none."""
    value = F.coalesce(value, F.lit(""))
    digit = value.rlike(language.java(r"\d"))  # what a pattern with a digit must hold, tested once
    marked = value.rlike("[®™]")

    def held(p: str) -> Column:
        test = value.rlike(language.java(anywhere(p)))
        if r"\d" in p:
            return digit & test
        if p.startswith("[A-Z]{3,}"):
            return marked & test
        first = re.match(r"\w{3,}", p)  # a literal that it begins with is looked for first
        return F.contains(value, F.lit(first[0])) & test if first else test

    return F.coalesce(*[F.when(held(p), F.lit(p)) for p in COMPOUNDS])


def assessed(rows: DataFrame, value: str, kind: str, confidence: str, context: str, document_type: Column, expected: Column) -> DataFrame:
    """rows with the five scores, their weighted total, whether they pass, why not, and the compound pattern of those that pass.

    A confidence of none or 0 is estimated from the value and its type.
    """
    parts = {
        "confidence": F.least(F.lit(1.0), F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), estimated(F.coalesce(F.col(value), F.lit("")), F.coalesce(F.col(kind), F.lit(""))))),
        "semantic": semantic_score(F.col(value), F.col(kind)),
        "length": length_score(F.col(value)),
        "context": context_score(F.col(value), F.col(context), document_type),
        "language": language.language_score(F.col(value), expected),
    }
    out = rows.withColumns({f"{k}_score": c for k, c in parts.items()})
    total = sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("final_score", F.round(total, 6))
    reason = F.coalesce(*[F.when(F.col(f"{k}_score") < least, F.concat(F.lit("Low confidence: " if k == "confidence" else f"Low {k} score: "), F.format_number(f"{k}_score", 2), F.lit(f" < {least}"))) for k, least in LEAST.items()])
    out = out.withColumn("rejection_reason", reason).withColumn("passed", F.col("rejection_reason").isNull())
    return out.withColumn("compound_pattern", F.when(F.col("passed"), compound_pattern(F.col(value))))


def rejections(verdicts: DataFrame, *by: str) -> DataFrame:
    """(by, failing, n, share, average scores): entities by what they fail first, null for those that pass."""
    first = F.regexp_extract("rejection_reason", r"^Low (\w+)", 1)
    n = verdicts.groupBy(*by, first.alias("failing")).agg(F.count("*").alias("n"), *[F.round(F.avg(f"{k}_score"), 6).alias(f"average_{k}") for k in ("confidence", "semantic", "final")])
    total = verdicts.groupBy(*by).agg(F.count("*").alias("total"))
    same = lambda: [F.col(f"n.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]
    joined = n.alias("n").join(total.alias("t"), same()) if by else n.alias("n").crossJoin(total.alias("t"))
    return joined.select(*[f"n.{c}" for c in by], "failing", "n", F.round(F.col("n.n") / F.col("total"), 6).alias("share"), "average_confidence", "average_semantic", "average_final")
