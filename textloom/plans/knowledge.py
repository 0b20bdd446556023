"""The knowledge graph over parts and suppliers, page relations, and measures that belong together."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import knowledge
from textloom.plans.documents import _values
from textloom.plans.registry import query
from textloom.sources.tables import load


def _graph(spark, folder):
    """Parts are the nodes of one domain, by their type's status; suppliers those of another, named after a part where one has their key."""
    part, supplier = load(spark, folder, "part"), load(spark, folder, "supplier")
    farm = part.where("p_type <> 'PROMO'").select(F.concat(F.lit("a"), "p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("value"), F.when(F.col("p_size") > 25, F.lower("p_name")).alias("normalized_value"), F.coalesce((F.col("p_size") / 50), F.lit(1.0)).alias("confidence"), F.lit("agricultural").alias("domain"), F.col("p_partkey").alias("written"))
    named = part.where("p_size < 30").select(F.col("p_partkey").alias("_k"), "p_name")
    foods = supplier.join(named, F.col("s_suppkey") == F.col("_k"), "left")
    key = F.concat(F.lit("food-"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    food = foods.select(key.alias("id"), F.lit("INGREDIENT").alias("type"), F.coalesce("p_name", F.concat(F.lit("Food Entity "), F.left(key, F.lit(8)))).alias("value"), F.lit(None).cast("string").alias("normalized_value"), F.lit(1.0).alias("confidence"), F.lit("food_industry").alias("domain"), F.col("s_suppkey").alias("written"))
    known = knowledge.nodes([farm, food])
    line = load(spark, folder, "lineitem")
    farm_links = line.select(F.concat(F.lit("a"), "l_partkey").alias("source"), F.concat(F.lit("a"), "l_suppkey").alias("target"), F.concat(F.lit("flag_"), "l_returnflag").alias("type"), F.col("l_discount").alias("strength"), F.lit(1.0).alias("confidence"), F.when(F.col("l_quantity") > 25, "large").otherwise("").alias("evidence"), F.lit("agricultural").alias("domain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("written"))
    food_links = supplier.select(key.alias("source"), key.alias("target"), F.lit("food_industry_context").alias("type"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("confidence"), F.col("s_name").alias("evidence"), F.lit("food_industry").alias("domain"), F.col("s_suppkey").alias("written"))
    return known, knowledge.edges([farm_links, food_links], known)


_GRAPH = """n AS (SELECT 'a' || p_partkey AS id, p_type AS type, p_name AS value, CASE WHEN p_size > 25 THEN lower(p_name) END AS normalized_value, p_size / 50.0::DOUBLE AS confidence, 'agricultural' AS domain FROM part WHERE p_type <> 'PROMO'
    UNION ALL SELECT 'food-' || lpad(s_suppkey::VARCHAR, 7, '0'), 'INGREDIENT', coalesce(p_name, 'Food Entity ' || substr('food-' || lpad(s_suppkey::VARCHAR, 7, '0'), 1, 8)), NULL, 1.0, 'food_industry' FROM supplier LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON s_suppkey = p_partkey),
    l AS (SELECT 'a' || l_partkey AS source, 'a' || l_suppkey AS target, 'flag_' || l_returnflag AS type, l_discount AS strength, 1.0::DOUBLE AS confidence, CASE WHEN l_quantity > 25 THEN 'large' ELSE '' END AS evidence, 'agricultural' AS domain, l_orderkey * 10 + l_linenumber AS written FROM lineitem
    UNION ALL SELECT 'food-' || lpad(s_suppkey::VARCHAR, 7, '0'), 'food-' || lpad(s_suppkey::VARCHAR, 7, '0'), 'food_industry_context', 1.0, 1.0, s_name, 'food_industry', s_suppkey FROM supplier),
    e AS (SELECT * EXCLUDE (written) FROM l WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY written DESC) = 1)"""


@query(f"WITH {_GRAPH} SELECT * FROM n")
def graph_nodes(spark, folder):
    return _graph(spark, folder)[0]


@query(f"WITH {_GRAPH} SELECT * FROM e")
def graph_edges(spark, folder):
    return _graph(spark, folder)[1]


@query(f"""WITH {_GRAPH} SELECT 'entity' AS kind, id AS first, value AS second, type FROM n WHERE contains(lower(value), 'ring') OR contains(lower(type), 'ring')
    UNION ALL SELECT 'relationship', s.value, t.value, e.type FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id WHERE contains(lower(e.type), 'flag_r')""")
def graph_search(spark, folder):
    known, links = _graph(spark, folder)
    found = knowledge.search_nodes(known, "Ring").select(F.lit("entity").alias("kind"), F.col("id").alias("first"), F.col("value").alias("second"), "type")
    return found.union(knowledge.search_edges(links, known, "flag_R").select(F.lit("relationship"), "source_value", "target_value", "type"))


@query(f"""WITH {_GRAPH} SELECT id, 'Entity: ' || value || chr(10) || 'Type: ' || type || chr(10) || 'Domain: ' || domain || coalesce(chr(10) || 'Normalized: ' || normalized_value, '') AS document FROM n
    UNION ALL SELECT source || '>' || target, 'Relationship: ' || s.value || ' ' || e.type || ' ' || t.value || chr(10) || 'Domain: ' || e.domain || CASE WHEN evidence <> '' THEN chr(10) || 'Evidence: ' || evidence ELSE '' END FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id""")
def graph_documents(spark, folder):
    """Without the lines of numbers, whose spelling differs between engines."""
    known, links = _graph(spark, folder)
    plain = F.regexp_replace("document", "\n(Strength|Confidence): [^\n]*", "")
    one = knowledge.node_texts(known).select("id", plain.alias("document"))
    return one.union(knowledge.edge_texts(links, known).select(F.concat_ws(">", "source", "target"), plain))


@query(f"""WITH {_GRAPH} SELECT 'total' AS kind, 'nodes' AS name, count(*) AS n FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e UNION ALL SELECT 'node_type', type, count(*) FROM n GROUP BY 2
    UNION ALL SELECT 'edge_type', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM n GROUP BY 2""")
def graph_statistics(spark, folder):
    return knowledge.statistics(*_graph(spark, folder))


_PAGED = "(SELECT l_orderkey AS doc_id, l_linenumber AS place, (l_quantity::INTEGER // 10) AS page, CASE p_type WHEN 'ECONOMY' THEN 'product' WHEN 'STANDARD' THEN 'parameter' WHEN 'PROMO' THEN 'regulatory' WHEN 'SMALL' THEN 'organization' WHEN 'MEDIUM' THEN 'material' ELSE 'specification' END AS type, p_name AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _paged(spark, folder):
    of = {"ECONOMY": "product", "STANDARD": "parameter", "PROMO": "regulatory", "SMALL": "organization", "MEDIUM": "material"}
    kind = F.lit("specification")
    for k, v in of.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    joined = load(spark, folder, "lineitem").join(load(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("place"), F.floor(F.col("l_quantity") / 10).cast("int").alias("page"), kind.alias("type"), F.col("p_name").alias("value"))


@query(f"""WITH f AS {_PAGED}, p AS (SELECT * FROM f WHERE type IN ('product', 'material'))
    SELECT p.doc_id AS doc, 'has_property' AS type, p.value AS entity_1, f.value AS entity_2 FROM p JOIN f USING (doc_id) WHERE f.type IN ('parameter', 'specification') AND abs(p.page - f.page) <= 1
    UNION ALL SELECT p.doc_id, 'regulatory_compliance', p.value, f.value FROM p JOIN f USING (doc_id) WHERE f.type = 'regulatory'
    UNION ALL SELECT p.doc_id, 'manufactures', o.value, p.value FROM p JOIN (SELECT doc_id, min({{'place': place, 'value': value}}).value AS value FROM f WHERE type = 'organization' GROUP BY 1) o USING (doc_id)
    UNION ALL SELECT a.doc_id, 'related_product', a.value, b.value FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.place < b.place""")
def page_relations(spark, folder):
    """Entities of an order's lines as those of a document's pages."""
    return knowledge.page_relations(_paged(spark, folder))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS place, CASE WHEN l_quantity > 30 THEN 'Bulk Density' ELSE 'Assay' END || l_linenumber AS property, CASE WHEN l_tax < 0.04 THEN l_returnflag END AS category, l_suppkey * 7 AS start FROM lineitem),
    r AS (SELECT DISTINCT a.doc, a.place, b.place AS other, b.property FROM f a JOIN f b ON a.doc = b.doc AND a.place <> b.place WHERE a.category IS NOT DISTINCT FROM b.category OR (contains(lower(a.property), 'density') AND contains(lower(b.property), 'density')) OR abs(a.start - b.start) < 200)
    SELECT doc, place, string_agg(property, ', ' ORDER BY other, property) AS related FROM r GROUP BY 1, 2""")
def related_measures(spark, folder):
    name = F.concat(F.when(F.col("l_quantity") > 30, "Bulk Density").otherwise("Assay"), F.col("l_linenumber").cast("string"))
    rows = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("place"), name.alias("property"), F.when(F.col("l_tax") < 0.04, F.col("l_returnflag")).alias("category"), (F.col("l_suppkey") * 7).alias("start"))
    return knowledge.related_measures(rows, "doc_id")


_COUNTS = [(0, 0), (2, 0), (0, 3), (1, 1)]


@query(f"SELECT *, CASE WHEN entities = 0 AND relations = 0 THEN 0.3 WHEN entities > 0 AND relations > 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence FROM (SELECT * FROM {_values(_COUNTS, 'entities, relations')} UNION ALL SELECT count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) FROM lineitem GROUP BY l_orderkey)")
def combined_confidence(spark, folder):
    met = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("entities"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)).alias("relations"))
    return spark.createDataFrame(_COUNTS, "entities long, relations long").union(met.select("entities", "relations")).withColumn("confidence", knowledge.combined_confidence(F.col("entities"), F.col("relations")))
