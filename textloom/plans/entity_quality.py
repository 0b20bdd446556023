"""Scores, verdicts and compounds of entities: the names of parts, every sentence of the documents, and stated values of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import entity_quality as quality
from textloom.operators.entity_language import SPACE, sql
from textloom.operators.measures import estimated
from textloom.plans import language
from textloom.plans.language import _q
from textloom.plans.registry import query
from textloom.sources.tables import dealt, load

KINDS = ["CHEMICAL_COMPOUND", "PRODUCT", "SPECIFICATION", "APPLICATION", "other"]
#: A context for each document type; the next kind's type is tried with it too.
CONTEXTS = [("sds", "Safety: chemical HAZARD"), ("technical", "value range of the page"), ("agricultural", "crop yield"), ("food", ""), (None, None)]
VALUES = [
    *language.VALUES, "Glycolate", "propylene", "acide citrique", "zinc oxide nitrate", "calcium magnésium", "Acme ®", "bread powder", "PGS 200252", "a-b-c", "LYCATAB® PGS", "PEARLITOL 200", "12.5 %", "pH: 5-7",
    "max 10 %", "5 g/cm³", "µm", "10 µm", "soil improving use", "recommended for bread", "utilisé comme agent", "and more", "x of", "this one", "is a thing", "peut être", "12", "max", "-", "product", "Données", "table 4", "voir", "fds",
    "American Chemical Society", "one two three four five six seven eight nine", "salt and", "sel pour", "NPK 10-5-5", "pH 6.5", "3.5% w/w", "10 kg/ha", "Loss on drying: 5%", "Perte au séchage: 3", "CAS No. 50-00-0", "E 471", "INS 471",
    "EC No 200-001-8", "N° CE 200-001-8", "EXP_123456789012", "SDS EN X1", "ACME®", "sodium starch glycolate®", "glycolate d'amidon sodique", "in the middle of", "tail\n", "Tail Name\n", "  padded  ", "ABCDEFGHI 1234567",
]
#: (id, value, type, confidence, context, document type): every value as each kind, below the keys of the tables.
STATED = [(-1 - i * 5 - j, v, k, [None, 0.0, 0.3, 0.8, 1.5][(i + j) % 5], CONTEXTS[(i + j) % 5][1], CONTEXTS[(i + 2 * j) % 5][0]) for i, v in enumerate(VALUES) for j, k in enumerate(KINDS)]
_S = "id long, v string, kind string, confidence double, context string, document_type string"


def _rows(spark, folder):
    parts = dealt(load(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_size"), 20_000)
    at = lambda i, n: F.get(F.array(*[F.lit(c[n]) for c in CONTEXTS]), F.pmod(i, F.lit(5)).cast("int"))
    kind = lambda i: F.get(F.array(*map(F.lit, KINDS)), F.pmod(i, F.lit(5)).cast("int"))
    named = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("v"), kind(F.col("p_partkey")).alias("kind"), (F.col("p_size") / 50).alias("confidence"), F.concat_ws(" ", "p_type", "p_name").alias("context"), at(F.col("p_size"), 0).alias("document_type"))
    docs = dealt(load(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    said = docs.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "[.\\n]")).alias("v"), F.col("lang").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.col("source").alias("context"), F.lit("technical").alias("document_type"))
    return named.union(said).union(spark.createDataFrame(STATED, _S))


_ARRAY = lambda values: "[" + ", ".join(map(_q, values)) + "]"
_PART = f"SELECT p_partkey AS id, p_name AS v, {_ARRAY(KINDS)}[p_partkey % 5 + 1] AS kind, p_size / 50.0::DOUBLE AS confidence, concat_ws(' ', p_type, p_name) AS context, {_ARRAY([c[0] for c in CONTEXTS])}[p_size % 5 + 1] AS document_type FROM part"
_SAID = "SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]')), lang, NULL::DOUBLE, source, 'technical' FROM documents"
_FIXED = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(v)}, {_q(k)}, {'NULL' if c is None else c}::DOUBLE, {_q(x)}, {_q(d)})" for i, v, k, c, x, d in STATED) + ") AS s(id, v, kind, confidence, context, document_type)"
_ANY = lambda text, ps, blind=False: "(" + " OR ".join(f"regexp_matches({text}, {_q(sql(p, blind))})" for p in ps) + ")"
_IF = lambda test, p: f"CASE WHEN {test} THEN {p} ELSE 0 END"
_COUNT = f"len(list_filter(regexp_split_to_array(v, '{SPACE}+'), lambda w: w <> ''))"
_BASE = f"""(SELECT *, upper(kind) AS k, lower(v) AS low, regexp_replace(lower(v), '^{SPACE}+|{SPACE}+$', '', 'g') AS trimmed, length(regexp_replace(v, '^{SPACE}+|{SPACE}+$', '', 'g')) AS n, {_COUNT} AS w, lower(context) AS c
    FROM (SELECT id, coalesce(v, '') AS v, coalesce(kind, '') AS kind, confidence, context, coalesce(document_type, '') AS document_type FROM ({_PART} UNION ALL {_SAID} UNION ALL {_FIXED})))"""
_SEMANTIC = " + ".join(
    [_IF(f"k = {_q(k)} AND {_ANY('v', [quality.whole(p) for p in ps], True)}", bonus) for k, (bonus, ps) in quality.MEANINGFUL.items()]
    + [_IF(_ANY("trimmed", [quality.ended(p) for p in ps]), -loss) for loss, ps in quality.NOISE.values()]
    + [_IF(f"k = 'CHEMICAL_COMPOUND' AND {language.VALIDITY} < 0.3", -0.3), _IF("w > 8", -0.2), _IF("length(v) - length(replace(v, ' ', '')) > 6", -0.2)]
    + [_IF(_ANY("trimmed", [p]), -0.3) for p in quality.OPEN_ENDS]
)
_HITS = " + ".join(_IF(f"document_type = '{k}' AND contains(c, '{w}')", 0.1) for k, words in quality.INDICATORS.items() for w in words)
_CONTEXT = f"CASE WHEN coalesce(context, '') = '' THEN 0.6 ELSE greatest(0.0, least(1.0, 0.5 + {_HITS} + {_IF('contains(c, lower(v))', 0.2)} - {_IF('(' + ' OR '.join(f'contains(c, {_q(w)})' for w in quality.FURNITURE) + ')', 0.3)})) END"


@query(f"""SELECT id, v, kind, round(greatest(0.0, least(1.0, 0.5 + {_SEMANTIC})), 6)::DOUBLE AS semantic_score,
    (CASE WHEN v = '' THEN 0.0 WHEN n < 2 THEN 0.1 WHEN w > 6 THEN 0.3 WHEN n BETWEEN 3 AND 30 AND w <= 4 THEN 1.0 WHEN n <= 50 THEN 0.8 ELSE 0.6 END)::DOUBLE AS length_score,
    round({_CONTEXT}, 6)::DOUBLE AS context_score, CASE {" ".join(f"WHEN regexp_matches(v, {_q(sql(quality.anywhere(p)))}) THEN {_q(p)}" for p in quality.COMPOUNDS)} END AS compound_pattern FROM {_BASE}""")
def entity_scores(spark, folder):
    """The parts of the quality of an entity that its type, context and compounds decide; the language's have a query of their own."""
    rows = _rows(spark, folder)
    found = {"semantic_score": quality.semantic_score(F.col("v"), F.col("kind")), "length_score": quality.length_score(F.col("v")), "context_score": quality.context_score(F.col("v"), F.col("context"), F.col("document_type"))}
    return rows.select("id", F.coalesce("v", F.lit("")).alias("v"), F.coalesce("kind", F.lit("")).alias("kind"), *[c.alias(n) for n, c in found.items()], quality.compound_pattern(F.col("v")).alias("compound_pattern"))


@query()
def entity_verdicts(spark, folder):
    """Every entity with its scores and why it fails, in English or French by its key; tested against plain Python."""
    expected = F.when(F.col("id") % 2 == 0, "english").otherwise("french")
    return quality.assessed(_rows(spark, folder), "v", "kind", "confidence", "context", F.col("document_type"), expected)


@query()
def verdict_counts(spark, folder):
    """How many entities pass, and how many fail for each reason and type; tested against plain Python."""
    return quality.rejections(entity_verdicts(spark, folder), "kind")
