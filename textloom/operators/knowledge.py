"""A knowledge graph as node and edge tables: loading from several domains, building, searching, telling as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import valid_edges


def nodes(parts: list[DataFrame]) -> DataFrame:
    """id, type, value, normalized_value, confidence, domain of all domains; of rows of one id the last written stays.

    ``written`` tells the order, the later domain the later of equals.
    """
    tagged = reduce(DataFrame.unionByName, [p.withColumn("_domain", F.lit(i)) for i, p in enumerate(parts)])
    return _last(tagged, ["id"])


def edges(parts: list[DataFrame], known: DataFrame) -> DataFrame:
    """source, target, type, strength, confidence, evidence, domain between known nodes; of one pair the last written stays."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("_domain", F.lit(i)) for i, p in enumerate(parts)])
    return valid_edges(_last(tagged, ["source", "target"]), known, "source", "target", "id")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By max over structs, which combines before the shuffle: a hot key is no large group."""
    others = [c for c in rows.columns if c not in (*keys, "_domain", "written")]
    best = rows.groupBy(*keys).agg(F.max(F.struct("_domain", "written", *others)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def search_nodes(known: DataFrame, asked: str) -> DataFrame:
    """Nodes whose value or type contains what is asked, whatever the case."""
    low = F.lit(asked.lower())
    return known.where(F.contains(F.lower("value"), low) | F.contains(F.lower("type"), low))


def search_edges(links: DataFrame, known: DataFrame, asked: str) -> DataFrame:
    """Edges whose type contains what is asked, with their ends' values."""
    found = links.where(F.contains(F.lower("type"), F.lit(asked.lower())))
    name = lambda c: known.select(F.col("id").alias(c), F.col("value").alias(f"{c}_value"))
    return found.join(name("source"), "source").join(name("target"), "target")


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)  # nulls are left out


def _told(name: str, column: str) -> Column:
    return F.when(F.col(column) != "", F.concat(F.lit(f"{name}: "), F.col(column).cast("string")))


def node_texts(known: DataFrame, properties: dict[str, str] | None = None) -> DataFrame:
    """id, document: a line for each thing known of a node; properties: column by the name that its line has."""
    head = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for n, c in (("Entity", "value"), ("Type", "type"), ("Domain", "domain"), ("Confidence", "confidence"))]
    more = [_told(n, c) for n, c in ({"Normalized": "normalized_value"} | (properties or {})).items()]
    return known.select("id", _lines(*head, *more).alias("document"))


def edge_texts(links: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, document."""
    name = lambda c: known.select(F.col("id").alias(c), F.col("value").alias(f"_{c}"))
    joined = links.join(name("source"), "source").join(name("target"), "target")
    first = F.concat(F.lit("Relationship: "), F.concat_ws(" ", "_source", "type", "_target"))
    head = [F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in (("Strength", "strength"), ("Confidence", "confidence"), ("Domain", "domain"))]
    return joined.select("source", "target", _lines(first, *head, _told("Evidence", "evidence")).alias("document"))


def statistics(known: DataFrame, links: DataFrame) -> DataFrame:
    """kind, name, n: totals, and counts by node type, edge type and domain."""
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    return total(known, "nodes").union(total(links, "edges")).union(count(known, "node_type", "type")).union(count(links, "edge_type", "type")).union(count(known, "domain", "domain"))


def combined_confidence(entities: Column, relations: Column) -> Column:
    """0.3 without a match in the graph, 0.9 with matches of both kinds, else 0.6."""
    return F.when((entities == 0) & (relations == 0), 0.3).when((entities > 0) & (relations > 0), 0.9).otherwise(0.6)


def page_relations(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """type, entity_1, entity_2 of entities (doc, place, page, type, value) of one document.

    Products have the properties of their own and neighbouring pages, comply
    with all regulations, are made by the first organization, and are related to
    one another. Products and properties meet by page, so pairs are formed
    within three pages alone.
    """
    own = found.select(F.col(doc).alias("doc"), "place", "page", "type", "value")
    products = own.where(F.col("type").isin("product", "material", "substance", "chemical_compound"))
    a = products.select("doc", F.col("place").alias("a"), F.col("page").alias("at"), F.col("value").alias("entity_1"))
    of = lambda *kinds: own.where(F.col("type").isin(*kinds)).select("doc", F.col("place").alias("b"), "page", F.col("value").alias("entity_2"))
    near = of("parameter", "property", "specification", "value").withColumn("at", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))
    named = lambda df, kind: df.select("doc", F.lit(kind).alias("type"), "entity_1", "entity_2")
    maker = own.where("type = 'organization'").groupBy("doc").agg(F.min(F.struct("place", "value"))["value"].alias("maker"))
    b = a.select("doc", F.col("a").alias("b"), F.col("entity_1").alias("entity_2"))
    made = a.join(maker, "doc").select("doc", F.lit("manufactures").alias("type"), F.col("maker").alias("entity_1"), F.col("entity_1").alias("entity_2"))
    return named(a.join(near, ["doc", "at"]), "has_property").union(named(a.join(of("regulatory"), "doc"), "regulatory_compliance")).union(made).union(named(a.join(b, "doc").where("a < b"), "related_product"))


def related_measures(found: DataFrame, doc: str, reach: int = 200) -> DataFrame:
    """(doc, place, related): for each measure the properties of the others of its category, of its kind if physical, or within reach.

    found: doc, place, property, category, start. Pairs are joined by category,
    by being physical, and by bands of the reach, never by document alone.
    """
    own = found.select(F.col(doc).alias("doc"), "place", "property", "category", "start")
    low = F.lower("property")
    physical = F.contains(low, F.lit("density")) | F.contains(low, F.lit("particle")) | F.contains(low, F.lit("moisture"))
    marked = own.withColumn("physical", physical)
    other = marked.select("doc", F.col("place").alias("other"), F.col("property").alias("said"), F.col("category").alias("_category"), F.col("start").alias("_start"), F.col("physical").alias("_physical"))
    same = marked.join(other, (marked["doc"] == other["doc"]) & marked["category"].eqNullSafe(other["_category"])).drop(other["doc"])
    alike = marked.where("physical").join(other.where("_physical"), "doc")
    bands = marked.withColumn("band", F.floor(F.col("start") / reach))
    beside = other.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("_start") / reach) + i)))
    close = bands.join(beside, ["doc", "band"]).where(F.abs(F.col("start") - F.col("_start")) < reach)
    pairs = reduce(DataFrame.union, [x.where("place <> other").select("doc", "place", "other", "said") for x in (same, alike, close)]).distinct()
    return pairs.groupBy("doc", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "said"))), lambda x: x["said"]), ", ").alias("related"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
