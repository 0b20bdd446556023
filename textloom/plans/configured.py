"""Configured product and food entities and food relations, over the documents and texts that hold every kind.

Places and contexts are beyond SQL: they are tested against a search pattern by
pattern in plain Python. The hits of examples have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import configured, entity_config
from textloom.plans.registry import query
from textloom.sources.tables import dealt, load

TEXTS = [
    (-1, "GLYCOLYS® sodium starch glycolate, CAS: 9063-38-1, EINECS 618-430-8, pH: 5.5 and 10 % moisture; specification value 25 °C, 5 kPa, 3 cP, 20 mg"),
    (-2, "Used as disintegrant and excipient, a binding agent with the function of flow aid. GHS07 H315 P280 EUH031 skin irritation hazard warning, LD50"),
    (-3, "FDA, EFSA, USP, EP, JP, GMP, HACCP, ISO 9001, EN 455 compliance. Store at 15-25 °C, relative humidity 40-60 %, shelf life 36 months, keep dry, protect from light"),
    (-4, "Roquette company, 62136 Lestrem, contact: info@roquette.com, +33 321-6336000. Acme Ltd supplier address"),
    (-5, "Xanthan gum is an ingredient used in dairy products as additive stabilizer. Sodium benzoate acts as preservative. Lecithin, citric acid and stevia extract"),
    (-6, "Vitamin C: 60 mg, calcium 120 mg mineral supplement; omega-3, probiotics and amino acids. GRAS status, E330, food grade, Kosher certified, FDA approved standard"),
    (-7, "Contains milk, eggs and wheat. Gluten-free, may contain traces, allergen control program. Shelf life: 12 months, food quality"),
    (-8, "Spray drying, fermentation and cold pressing. Refrigerated storage, vacuum-packed, modified atmosphere packaging. Critical control point, mixing, quality control, premix, batch formula"),
    (-9, "Citric acid provides antioxidant function as food additive. Pectin approved for bakery goods, an ingredient permitted in food grade goods.  Carrageenan replaces lecithin as substitute ingredient."),
    (-10, "Curcumin\tenhances   shelf stability and improves lycopene food colour. Lecithin contains soy, a source of allergen food. Mixing followed by heating, then cooling."),
    (-11, "Mixed iron; ironing is no hit, nor is environment. IRON! iron"),
    (-12, ""),
    (-13, None),
]


def _rows(spark, folder):
    return dealt(load(spark, folder, "documents").select("doc_id", "text")).union(spark.createDataFrame(TEXTS, "doc_id long, text string"))


@query()
def product_entities(spark, folder):
    return configured.products(_rows(spark, folder), "doc_id", "text").drop("context").withColumn("confidence", F.round("confidence", 6))


@query()
def food_entities(spark, folder):
    """Foods alone; the products beside them are those of product_entities."""
    found = configured.foods(_rows(spark, folder), "doc_id", "text", and_products=False)
    return found.withColumns({"confidence": F.round("confidence", 6), "contains": F.array_join("contains", "|")}).drop("place", "context")


@query()
def food_relations(spark, folder):
    return configured.food_relations(_rows(spark, folder), "doc_id", "text").withColumn("confidence", F.round("confidence", 6))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_E = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, listed in entity_config.FOOD_EXAMPLES.items() for v in listed)
_T = ", ".join(f"({i}, {'NULL' if t is None else _quoted(t)})" for i, t in TEXTS)


@query(rf"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_T}) AS v(doc_id, text))),
    e AS (SELECT * FROM (VALUES {_E}) AS v(kind, value)),
    p AS (SELECT doc_id, kind, value, string_split(t, lower(value)) AS parts FROM d, e WHERE contains(t, lower(value))),
    h AS (SELECT doc_id, kind, value, len(list_filter(range(1, len(parts)), lambda i:
        (CASE WHEN parts[i] = '' THEN i = 1 ELSE NOT regexp_matches(right(parts[i], 1), '[\pL\pN]') END)
        AND (CASE WHEN parts[i + 1] = '' THEN i + 1 = len(parts) ELSE NOT regexp_matches(left(parts[i + 1], 1), '[\pL\pN]') END))) AS hits FROM p)
    SELECT doc_id, kind, value, sum(hits)::BIGINT AS hits FROM h WHERE hits > 0 GROUP BY ALL""")
def food_example_hits(spark, folder):
    return configured.example_hits(_rows(spark, folder), "doc_id", "text")
