"""Facts of texts and entities: normal spellings, specifications, food facts, and context for answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.normalize import normalized
from textloom.operators import answers, search, specs
from textloom.plans.compounds import TEXTS
from textloom.plans.registry import query
from textloom.sources.tables import load

_KINDS = {"ECONOMY": "PRODUCT", "STANDARD": "SPECIFICATION", "PROMO": "SAFETY_HAZARD", "SMALL": "NUTRIENT", "MEDIUM": "CROP", "LARGE": "CHEMICAL_COMPOUND"}


@query(r"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN upper(p_name) || ' ' || p_size WHEN 'STANDARD' THEN 'pH ' || p_size || ' at ' || p_size || '%' WHEN 'PROMO' THEN 'GHS0' || (p_size % 10) || ' H301'
    WHEN 'SMALL' THEN 'zn' WHEN 'MEDIUM' THEN 'maize' WHEN 'LARGE' THEN 'cas: ' || (p_size + 100) || '-18-5' ELSE p_name END AS normal FROM part""")
def normalize_entities(spark, folder):
    rows, size = load(spark, folder, "part"), F.col("p_size").cast("string")
    spelled = {
        "PRODUCT": F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("_")), size),
        "SPECIFICATION": F.concat(F.lit("ph="), size, F.lit("  at "), size, F.lit(" percent.")),
        "SAFETY_HAZARD": F.concat(F.lit("ghs "), (F.col("p_size") % 10).cast("string"), F.lit(" h 301")),
        "NUTRIENT": F.lit("Total Zinc"),
        "CROP": F.lit(" Zea mays "),
        "CHEMICAL_COMPOUND": F.concat(F.lit("reg. no. "), (F.col("p_size") + 100).cast("string"), F.lit("-18-5")),
    }
    kind = F.lit(None).cast("string")
    for p_type, name in _KINDS.items():
        kind = F.when(F.col("p_type") == p_type, name).otherwise(kind)
    value = F.col("p_name")
    for name, text in spelled.items():
        value = F.when(F.col("kind") == name, text).otherwise(value)
    return rows.withColumn("kind", kind).select("p_partkey", normalized(value, F.col("kind")).alias("normal"))


@query()
def lab_specifications(spark, folder):
    """Specifications in the documents and in texts that state every kind; tested on stated texts."""
    rows = load(spark, folder, "documents").select("doc_id", "text").union(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    return specs.specifications(rows, "doc_id", "text")


@query()
def food_facts(spark, folder):
    """Nutrition, allergens, regulation and storage of every document; tested on stated texts."""
    text = F.col("text")
    facts = load(spark, folder, "documents").select("doc_id", specs.nutrition(text).alias("n"), specs.allergens(text).alias("a"), specs.food_regulation(text).alias("r"), specs.storage_conditions(text).alias("s"))
    return facts.select("doc_id", F.to_json("n").alias("nutrition"), F.to_json("a").alias("allergens"), F.to_json("r").alias("regulation"), F.array_join("s", ", ").alias("storage"))


_SCORE = "(contains(lower(text), 'the')::INTEGER + contains(lower(text), 'and')::INTEGER)"


@query(f"""SELECT source, count(*)::INTEGER AS pieces, sha256(string_agg('[Document: ' || doc_id || ', Page: Unknown]' || chr(10) || CASE WHEN length(text) > 500 THEN text[1:500] || '...' ELSE text END, chr(10) || chr(10) ORDER BY p)) AS digest,
    '**Sources:** ' || string_agg(doc_id || ' (Page Unknown)', ', ' ORDER BY p) AS sources
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_SCORE} DESC, doc_id) AS p FROM documents WHERE {_SCORE} > 0) WHERE p <= 3 GROUP BY source""")
def answer_contexts(spark, folder):
    found = search.keyword_score(load(spark, folder, "documents"), "text", ["the", "and"]).withColumn("page", F.lit(None).cast("int"))
    built = answers.contexts(found, "source", [F.desc("score"), F.asc("doc_id")], "doc_id", "page", "text")
    return built.select("source", "pieces", F.sha2("context", 256).alias("digest"), "sources")
