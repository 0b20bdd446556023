"""The language of entities: of a sample by weighted evidence, of each against what is expected, and whether a value may name a chemical.

Patterns are stated once and made for Java's or SQL's expressions by java() and
sql(): letters, digits and white space are those of Unicode in both.

Defined results: null values are empty ones and null keys a group of their own;
an empty sample, or evidence under 2, is English; French needs more evidence
than English; repeated rows count each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words, patterns and phrases of each language.
WORDS = {
    "english": ["the", "a", "an", "in", "on", "at", "by", "for", "with", "from", "to", "into", "onto", "is", "are", "this", "that", "can", "may", "will", "shall", "such", "each"],
    "french": ["le", "la", "les", "un", "une", "des", "du", "de", "dans", "aux", "au", "sur", "avec", "pour", "par", "dans", "sans", "sous", "vers", "chez", "entre", "est", "sont", "cette", "peut", "doit", "selon", "entre", "cas", "tout", "tous"],
}
PATTERNS = {
    "english": [
        r"\b(?:specification|property|characteristic|requirement)\b",
        r"\b(?:content|level|maximum|minimum|typical)\b",
        r"\b(?:application|method|procedure|process)\b",
        r"\b(?:safety|data|sheet|material|chemical)\b",
        r"\b(?:product|ingredient|component|substance)\b",
    ],
    "french": [
        r"\b(?:fiche|données|sécurité|rubrique|identification)\b",
        r"\b(?:contact|avec|rincer|obtenir|médical)\b",
        r"\b(?:classification|selon|danger|information)\b",
        r"\b(?:mesures|protection|individuelle|collective)\b",
        r"\b(?:produit|substance|composé|ingrédient)\b",
        r"\b(?:concentration|limite|exposition|niveau)\b",
    ],
}
PHRASES = {
    "english": [
        r"\b(?:and such may|be used as|based on the|apply to them)\b",
        r"\b(?:in case of|contact with|wash with|obtain medical)\b",
        r"\b(?:information on|classification according|limit of|important level)\b",
    ],
    "french": [
        r"\b(?:en cas de|dans la|de la|des produits|avec de|pour la|sur la)\b",
        r"\b(?:apporter en|obtenir des|laver avec|contact avec|mesures de)\b",
        r"\b(?:informations sur|classification selon|limite de|niveau important)\b",
        r"\b(?:bottes en|division of|bibliographiques et|bioaccumulable et)\b",
    ],
}
#: Marks of French documents, whatever their case (fixed values).
FRENCH_MARKS = [r"\bFDS\b", r"\bdans\s+la\b", r"\bde\s+la\b", r"\bavec\s+de\b", r"\ben\s+cas\s+de\b", r"\bmesures\s+de\b", r"\bclassification\s+selon\b"]
TRADEMARKS = [r"®", r"™", r"\bTM\b", r"\bREG\b"]
#: Weights of a word, a pattern, a phrase and a mark (fixed values).
WEIGHTS = {"word": 2, "pattern": 1, "phrase": 3, "mark": 2}
# What a chemical's name looks like, what it doesn't, and words that speak for and against one.
VALID_NAMES = [
    r"^[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*(?:\s+\d+)?(?:\s*[®™])?$",
    r"^\w+(?:-\w+)*(?:\s+\w+)*(?:\s*[®™])?$",
    r"^(?:sodium|potassium|calcium|magnesium|aluminum|zinc|iron|copper)\s+\w+(?:\s+\w+)?$",
    r"^\w*(?:amine|acid|oxide|hydroxide|sulfate|chloride|nitrate|phosphate|glycolate|starch)\w*$",
    r"^(?:sodium|potassium|calcium|magnésium|aluminium|zinc|fer|cuivre)\s+\w+(?:\s+\w+)?$",
    r"^\w*(?:amine|acide|oxyde|hydroxyde|sulfate|chlorure|nitrate|phosphate|glycolate|amidon)\w*$",
    r"^LYCATAB(?:\s*®)?(?:\s+[A-Z]+)?$",
    r"^PEARLITOL(?:\s*®)?(?:\s+[A-Z]+)?$",
    r"^[A-Z]{3,}(?:\s*[®™])?(?:\s+[A-Z0-9]+)?$",
    r"^\w+\s+(?:starch|glycolate|mannitol|sorbitol|cellulose)(?:\s*[®™])?$",
    r"^(?:hypromellose|hydroxypropyl|methylcellulose)(?:\s+\w+)?(?:\s*[®™])?$",
]
INVALID_NAMES = [
    r"^\w+(?:\s+\w+)*\s+(?:is|are|was|were|and|or|but|the|of|in|on|at|to|for)$",
    r"^(?:high|low|medium|good|bad|excellent|poor)\s+\w+$",
    r"^(?:used|suitable|recommended|intended)\s+for\s+\w+$",
    r"^(?:can|may|must|shall|will|would)\s+be\s+\w+$",
    r"^\w+(?:\s+\w+)*\s+(?:est|sont|était|étaient|et|ou|mais|le|la|les|de|du|des|dans|sur)$",
    r"^(?:haut|bas|moyen|bon|mauvais|excellent|pauvre)\s+\w+$",
    r"^(?:utilisé|approprié|recommandé|destiné)\s+pour\s+\w+$",
    r"^(?:peut|doit|va|aller)\s+être\s+\w+$",
    r"^(?:contact avec|mesures de|informations sur|classification selon)$",
    r"^(?:en cas de|niveau important de|limite de concentration)$",
]
FOR = ["acid", "oxide", "hydroxide", "sulfate", "chloride", "nitrate", "phosphate", "sodium", "potassium", "calcium", "magnesium", "aluminum", "zinc", "iron", "methyl", "ethyl", "propyl", "butyl", "phenyl", "benzyl", "amine", "alcohol", "ester", "ether", "ketone", "aldehyde"]
AGAINST = ["is used", "can be", "may be", "will be", "should be", "has been", "was used", "are used", "were used", "suitable for", "recommended for", "intended for", "application", "property", "characteristic", "feature"]

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"


def _plain(pattern: str) -> str:
    """Letters and borders of Unicode, in terms that Java and SQL share; a border takes up a character, so this only tells whether there is a match."""
    pattern = pattern.replace(r"\w+(?:\s+\w+)*\s+", r"\w(?:[\w\s]*\w)?\s+")  # the same words, without a group to go back into
    inside = {r"\w": r"\pL\pN_", r"\s": SPACE[1:-1], r"\d": r"\p{Nd}"}
    # A class stands alone in brackets, or, within others, as what it holds.
    words = re.sub(r"\[[^\]]*\]|\\[wsd]", lambda m: re.sub(r"\\[wsd]", lambda c: inside[c[0]], m[0] if m[0][0] == "[" else f"[{m[0]}]"), pattern)
    return re.sub(r"\\b$", r"(?:$|[^\\pL\\pN_])", re.sub(r"^\\b", r"(?:^|[^\\pL\\pN_])", words))


def java(pattern: str, blind: bool = False) -> str:
    """For Java: no repeated group here is followed by what it could have taken, so none needs giving back, which keeps long values off the stack."""
    return ("(?iu)" if blind else "") + _plain(pattern).replace(")*", ")*+").replace(")*++", ")*+")


def sql(pattern: str, blind: bool = False) -> str:
    return ("(?i)" if blind else "") + _plain(pattern)


def any_of(text: Column, patterns: list[str], blind: bool = False) -> Column:
    """Whether any pattern matches; patterns that begin alike share their beginning, which is tried once a place."""
    left, parts = [java(p) for p in patterns], []
    for head in ("^", r"(?:^|[^\pL\pN_])", ""):
        parts += [head + "(?:" + "|".join(p[len(head) :] for p in left if p.startswith(head)) + ")"] if any(p.startswith(head) for p in left) else []
        left = [p for p in left if not p.startswith(head)]
    return text.rlike(("(?iu)" if blind else "") + "|".join(parts))


def stripped(text: Column) -> Column:
    """Without white space at the ends; a run of it is looked at once, and only where one of the ends is some."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")).otherwise(text)


def evidence(value: Column) -> dict[str, Column]:
    """What a value counts for each language."""
    low = F.lower(value)
    hits = lambda text, patterns, weight, blind=False: sum((F.when(text.rlike(java(p, blind)), weight).otherwise(0) for p in patterns), F.lit(0))
    out = {}
    for lang in WORDS:
        score = F.when(low.isin(WORDS[lang]), WEIGHTS["word"]).otherwise(0) + hits(low, PATTERNS[lang], WEIGHTS["pattern"]) + hits(low, PHRASES[lang], WEIGHTS["phrase"])
        out[lang] = score + hits(value, FRENCH_MARKS, WEIGHTS["mark"], True) if lang == "french" else score
    return out


def sample_language(rows: DataFrame, key: str, place: str, value: str, sample: int = 50) -> DataFrame:
    """(key, english, french, language): the evidence of each key's first ``sample`` values, and what it says."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(place, value))).where(F.col("_n") <= sample)
    summed = first.groupBy(key).agg(*[F.sum(c).alias(lang) for lang, c in evidence(F.coalesce(F.col(value), F.lit(""))).items()])
    return summed.withColumn("language", F.when((F.col("french") >= 2) & (F.col("french") > F.col("english")), "french").otherwise("english"))


def language_score(value: Column, expected: Column) -> Column:
    """How well a value goes with the expected language; 0.8 where that is another than English and French."""
    value = F.coalesce(value, F.lit(""))
    low = F.lower(value)

    def against(wrong: str) -> Column:
        return (
            F.when(low.isin(WORDS[wrong]), 0.2)
            .when(any_of(low, PHRASES[wrong]), 0.1)
            .when(any_of(low, PATTERNS[wrong]), 0.3)
            .when(any_of(value, TRADEMARKS), 1.0)
            .otherwise(0.9)
        )

    french = F.when(any_of(low, PHRASES["french"]), 0.1).otherwise(against("english"))
    return F.when(expected == "english", against("french")).when(expected == "french", french).otherwise(0.8)


def chemical_validity(value: Column) -> Column:
    """From 0 to 1: whether a value looks like the name of a chemical."""
    value = F.coalesce(value, F.lit(""))
    low = F.lower(value)
    held = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    words = F.size(F.filter(F.split(value, f"{SPACE}+"), lambda w: w != ""))
    points = [
        (any_of(value, VALID_NAMES, True), 0.3),
        (any_of(stripped(low), INVALID_NAMES), -0.4),
        (words <= 4, 0.1),
        (held(FOR), 0.2),
        (value.rlike("[®™]"), 0.2),
        (value.rlike("^[A-Z]"), 0.1),
        (held(AGAINST), -0.3),
    ]
    score = sum((F.when(test, p).otherwise(0.0) for test, p in points), F.lit(0.5))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
