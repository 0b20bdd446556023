"""Food and general specifications and compound entities, over the documents and texts that hold every kind.

Their columns have places, which SQL can't give: tested against plain Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from textloom.operators import chunking, compounds
from textloom.plans.registry import query
from textloom.sources.tables import dealt, load

TEXTS = [
    (-1, "Protein: 12.5 g per 100g, Fat: 3 g. Total plate count: <1000 CFU/g max; Salmonella: Absent per 25g. pH: 4.2 - 4.6 units"),
    (-2, "Processing temperature: 72 °C for 15 seconds. Shelf life: 18 months from production\nStorage: cool and dry place\nNet weight: 500 g"),
    (-3, "Ingredients: water, sugar, wheat flour, salt (organic). Contains: milk and traces of nuts. Non-GMO: as certified. HACCP"),
    (-4, "Color: light brown and even. Preservatives: sorbate and benzoate. Serving size: 30 g. Expiry: 12 months from packing. Keep at a cool and dry place"),
    (-5, "Flow rate: 5 kg/h typical Temp: 60 °C and width = 3.5 mm, range of speed 10-20 rpm; Bulk density: 0.4 - 0.6 g/cm³"),
    (-6, "Loss on drying: 5.0% max at 105 °C. Particle size (D50): 10 - 20 μm. Composition: 60% maize starch + 40% wheat flour. Heavy metals: 10 ppm max"),
    (-7, "Total aerobic count: 1000 CFU/g max. Assay: 98.0-102.0% (dried). Density: 10 to 20 g/ml. 20% salt + 30% water. food grade type A2"),
    (-8, "The Licensee shall pay all of the fees within 30 days of the date. Liability shall not exceed the fees of the year. $1,000.00 as a deposit"),
    (-9, 'Performance shall be maintained at the level agreed. "Goods" means the things sold. Notice before the end of the term'),
    (-10, "Application rate: 5 kg/ha of Product on Maize. High Efficacy: Product X increases grain yield by 12%. Chemical composition: Humus (30% carbon)"),
    (-11, "Safety interval: 14 days before harvest for apples. Effect: stronger roots in dry years. Apply: in spring on moist soil"),
    (-12, ""),
    (-13, None),
]


def _rows(spark, folder):
    return dealt(load(spark, folder, "documents").select("doc_id", "text")).union(spark.createDataFrame(TEXTS, "doc_id long, text string"))


@query()
def food_specifications(spark, folder):
    return compounds.food_specifications(_rows(spark, folder), "doc_id", "text")


@query()
def general_specifications(spark, folder):
    return compounds.general_specifications(_rows(spark, folder), "doc_id", "text")


@query()
def compound_entities(spark, folder):
    """Compounds of every domain."""
    return reduce(lambda a, b: a.union(b), [compounds.compound_entities(_rows(spark, folder), "doc_id", "text", d) for d in compounds.COMPOUNDS])


@query()
def entity_chunks(spark, folder):
    """Pieces of every text that leave its general compounds whole."""
    rows = _rows(spark, folder)
    found = compounds.compound_entities(rows, "doc_id", "text").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.lit(True).alias("compound"))).alias("entities"))
    pieces = chunking.split_documents(rows.join(found, "doc_id", "left"), "doc_id", "text", entities="entities")
    return pieces.select("doc_id", "chunk_order", "start", F.length("chunk_text").alias("n_chars"))
