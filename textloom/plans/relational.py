"""Joins, access rules, upserts, and dedup over the business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.text import normalized_product, normalized_specification
from textloom.functions.vectors import trigram_similarity
from textloom.operators import clusters, maintenance, relations, search
from textloom.plans.registry import query
from textloom.sources.tables import load, matching


@query("""WITH t AS (SELECT *, count(*) OVER (PARTITION BY p_name) AS occurrences FROM part WHERE contains(lower(p_name), 'ring'))
    SELECT p_partkey, p_name, occurrences FROM t ORDER BY occurrences DESC, p_retailprice DESC, p_partkey LIMIT 20""")
def entity_search_occurrence(spark, folder):
    found = search.entities(load(spark, folder, "part"), "p_name", "ring", "p_retailprice", "p_partkey")
    return found.select("p_partkey", "p_name", "occurrences")


@query("SELECT p_partkey, p_size FROM part WHERE p_type = 'ECONOMY' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY p_size DESC, p_partkey LIMIT 50")
def ingredient_search_anti(spark, folder):
    returned = load(spark, folder, "lineitem").where("l_returnflag = 'R'")
    free = relations.without(load(spark, folder, "part").where("p_type = 'ECONOMY'"), returned, "p_partkey", "l_partkey")
    return free.orderBy(F.desc("p_size"), "p_partkey").limit(50).select("p_partkey", "p_size")


@query("SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS has_large FROM part")
def exists_flag(spark, folder):
    large = load(spark, folder, "lineitem").where("l_quantity >= 49")
    return relations.flagged(load(spark, folder, "part").select("p_partkey"), large, "p_partkey", "l_partkey", "has_large")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def secured_orders(spark, folder):
    """Orders that a customer owns, or that one of the supplier's lines grants."""
    grants = load(spark, folder, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.secured(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 7, "o_orderkey", grants)


@query("""SELECT l_orderkey, l_linenumber, p_name AS source, coalesce(s_name, 'Supplier ' || l_suppkey) AS target, l_quantity AS strength FROM lineitem
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 100""")
def relationship_double_left(spark, folder):
    lines, parts = load(spark, folder, "lineitem"), load(spark, folder, "part").select("p_partkey", F.col("p_name").alias("source"))
    suppliers = load(spark, folder, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey, "left").join(suppliers, lines.l_suppkey == suppliers.s_suppkey, "left")
    named = joined.select("l_orderkey", "l_linenumber", "source", F.coalesce("s_name", F.concat(F.lit("Supplier "), "l_suppkey")).alias("target"), F.col("l_quantity").alias("strength"))
    return named.orderBy(F.desc("strength"), "l_orderkey", "l_linenumber").limit(100)


@query("""SELECT d.lang, count(DISTINCT d.doc_id) AS documents, count(DISTINCT l.doc_id) AS labelled, count(DISTINCT c.conv_id) AS conversations
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN conversations c ON d.doc_id = c.conv_id GROUP BY d.lang""")
def docs_multi_left_distinct(spark, folder):
    docs, labels = load(spark, folder, "documents").select("doc_id", "lang"), load(spark, folder, "labels").select(F.col("doc_id").alias("l"))
    chats = load(spark, folder, "conversations").select("conv_id")
    joined = docs.join(labels, docs.doc_id == labels.l, "left").join(chats, docs.doc_id == chats.conv_id, "left")
    return joined.groupBy("lang").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("l").alias("labelled"), F.countDistinct("conv_id").alias("conversations"))


@query("""SELECT n_name, r_name, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM nation
    JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def project_counts(spark, folder):
    """Children counted per project, those without any kept."""
    nations = load(spark, folder, "nation").join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spent = load(spark, folder, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("t"))
    customers = load(spark, folder, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    joined = nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("t"), F.lit(0.0)), 2).alias("total"))


@query("""SELECT 'part' AS domain, p_name AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'supplier', s_name, count(*) FROM supplier GROUP BY 2
    UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2""")
def domain_union(spark, folder):
    parts = [(name, column, table) for name, column, table in (("part", "p_name", "part"), ("supplier", "s_name", "supplier"), ("segment", "c_mktsegment", "customer"))]
    frames = [load(spark, folder, t).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(d).alias("domain"), "value", "n") for d, c, t in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT DISTINCT p_brand, p_type FROM part INTERSECT SELECT p_brand, p_type FROM part WHERE p_size > 40")
def distinct_intersect(spark, folder):
    part = load(spark, folder, "part")
    return part.select("p_brand", "p_type").distinct().intersect(part.where("p_size > 40").select("p_brand", "p_type"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('P', 'F') AND o_orderpriority = '5-LOW' AND o_totalprice BETWEEN 100000 AND 120000")
def filter_by_params(spark, folder):
    """Predicates from a dict, an empty one left out, and a range."""
    test = matching({"o_orderstatus": ["P", "F"], "o_orderpriority": "5-LOW", "o_custkey": None})
    return load(spark, folder, "orders").where(test & F.col("o_totalprice").between(100000, 120000)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH new AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), old AS (SELECT c_custkey AS user_id, 0::BIGINT AS v FROM customer)
    SELECT coalesce(old.user_id, new.user_id) AS user_id, coalesce(new.v, old.v) AS v, new.v IS NOT NULL AS changed FROM old FULL JOIN new ON old.user_id = new.user_id""")
def upsert_merge(spark, folder):
    old = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("v"))
    new = load(spark, folder, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("v"))
    return maintenance.upsert(old, new, "user_id", "v")


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY 1")
def retention_keep(spark, folder):
    kept = maintenance.retained(load(spark, folder, "events"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'lineitem' AS table_name, count(*) FILTER (l_orderkey IN (SELECT * FROM k)) AS deleted, count(*) FILTER (l_orderkey NOT IN (SELECT * FROM k)) AS remaining FROM lineitem
    UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus = 'P'), count(*) FILTER (o_orderstatus <> 'P') FROM orders""")
def cascade_delete_counts(spark, folder):
    orders = load(spark, folder, "orders")
    return maintenance.cascade(orders.where("o_orderstatus = 'P'"), "o_orderkey", {"lineitem": (load(spark, folder, "lineitem"), "l_orderkey"), "orders": (orders, "o_orderkey")})


@query("SELECT p_name, p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_partkey) = 1")
def version_latest(spark, folder):
    latest = maintenance.first_of(load(spark, folder, "part"), [F.col("p_name"), F.col("p_brand")], F.desc("p_size"), "p_partkey")
    return latest.select("p_name", "p_brand", "p_partkey", "p_size")


@query("""WITH a AS (SELECT l_suppkey AS k, l_orderkey AS o, datediff('day', DATE '1995-01-01', l_shipdate::DATE) AS x FROM lineitem WHERE l_returnflag = 'A'),
    b AS (SELECT l_suppkey AS k, l_orderkey AS p, datediff('day', DATE '1995-01-01', l_shipdate::DATE) AS y FROM lineitem WHERE l_returnflag = 'R')
    SELECT k, o, p, abs(x - y)::INTEGER AS distance FROM a JOIN b USING (k) WHERE abs(x - y) <= 60""")
def band_pairs(spark, folder):
    """Lines of one supplier and opposite kinds shipped within 60 days."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = load(spark, folder, "lineitem").withColumn("day", day)
    a = rows.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o"), F.col("day").alias("x"))
    b = rows.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("p"), F.col("day").alias("y"))
    return relations.band_join(a, b, "k", "x", "y", 60).select("k", "o", "p", F.abs(F.col("x") - F.col("y")).alias("distance"))


@query("""WITH r AS (SELECT l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS b FROM lineitem),
    m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT k, min(a) AS a, max(b) AS b, count(*) AS members FROM i GROUP BY k, island""")
def interval_merge(spark, folder):
    day = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400).cast("long")
    rows = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b"))
    return relations.merged_intervals(rows, "k", "a", "b").drop("island")


@query()
def interval_overlap_dedupe(spark, folder):
    """Greedy earliest-first choice of spans; a sequential rule, tested against plain Python."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    rows = load(spark, folder, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("a"), (day + F.col("l_quantity").cast("long")).alias("b")).distinct()
    return relations.first_spans(rows, ["k"], "a", "b")


@query("""WITH t AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i::INTEGER, 3))) AS x,
    list_distinct(list_transform(range(1, length('red ring') + 2), lambda i: substr('  red ring ', i::INTEGER, 3))) AS y FROM t)
    SELECT p_name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM g ORDER BY similarity DESC, p_name LIMIT 10""")
def trigram_similarity_topk(spark, folder):
    names = load(spark, folder, "part").select("p_name").distinct()
    return names.withColumn("similarity", F.round(trigram_similarity(F.col("p_name"), F.lit("red ring")), 6)).orderBy(F.desc("similarity"), "p_name").limit(10)


@query("SELECT p_partkey, upper(replace(replace(p_brand, '#', ' '), '-', ' ')) AS plain, CASE WHEN p_size <= 9 THEN 'n' || p_size ELSE 'n' || p_size || '%' END AS size_text FROM part")
def normalize_product(spark, folder):
    marked = F.upper(F.replace("p_brand", F.lit("#"), F.lit("-")))
    size = F.when(F.col("p_size") <= 9, F.concat(F.lit("n"), "p_size")).otherwise(F.concat(F.lit("n"), "p_size", F.lit(" percent")))
    return load(spark, folder, "part").select("p_partkey", normalized_product(marked).alias("plain"), normalized_specification(size).alias("size_text"))


@query("""SELECT p_partkey, p_size, round(p_retailprice * f, 6) AS converted FROM part JOIN (VALUES ('ECONOMY', 1.0::DOUBLE), ('STANDARD', 1.121::DOUBLE), ('PROMO', 10.0::DOUBLE)) u(unit, f) ON p_type = unit""")
def convert_units(spark, folder):
    units = spark.createDataFrame([("ECONOMY", 1.0), ("STANDARD", 1.121), ("PROMO", 10.0)], "unit string, factor double")  # a fixed handful of rows
    rows = load(spark, folder, "part")
    return rows.join(F.broadcast(units), rows.p_type == units.unit).select("p_partkey", "p_size", F.round(F.col("p_retailprice") * F.col("factor"), 6).alias("converted"))


@query()
def entity_clusters(spark, folder):
    """Greedy clusters of similar names of one type; a sequential rule, tested against plain Python."""
    return clusters.similarity_clusters(load(spark, folder, "part"), F.col("p_type"), "p_name", "p_retailprice")


@query("""SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P'
    WHERE c_acctbal > 5000 GROUP BY 1, 2""")
def customers_left_filtered(spark, folder):
    kept = load(spark, folder, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("best"))
    rows = load(spark, folder, "customer").where("c_acctbal > 5000")
    return rows.join(kept, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("n"), "best")


@query("""SELECT l_orderkey, count(*) AS n, max_by(l_partkey, l_extendedprice) AS best_part, round(avg(l_quantity), 6) AS avg_quantity, least(1.0, 0.8 + CASE WHEN count(*) > 2 THEN 0.1 ELSE 0 END + 0.1 * avg(l_discount))::DECIMAL(18,6)::DOUBLE AS preservation FROM lineitem GROUP BY 1""")
def compound_groups(spark, folder):
    """Groups with their best member, mean and preservation score."""
    score = F.least(F.lit(1.0), 0.8 + F.when(F.count("*") > 2, 0.1).otherwise(0.0) + 0.1 * F.avg("l_discount"))
    return load(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max_by("l_partkey", "l_extendedprice").alias("best_part"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.round(score, 6).alias("preservation"))


@query("""SELECT o_orderkey, CASE WHEN rn = 1 THEN 0.5 WHEN rn = 2 THEN 0.3 WHEN rn = 3 THEN 0.2 END::DOUBLE AS weight, round(o_totalprice / mx, 6) AS relative FROM
    (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, max(o_totalprice) OVER (PARTITION BY o_custkey) AS mx FROM orders) WHERE rn <= 3""")
def positional_weights(spark, folder):
    w = Window.partitionBy("o_custkey")
    ranked = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.max("o_totalprice").over(w).alias("most"))
    weight = F.element_at(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.col("rn"))
    return ranked.where("rn <= 3").select("o_orderkey", weight.alias("weight"), F.round(F.col("o_totalprice") / F.col("most"), 6).alias("relative"))


_NAMED = "SELECT doc_id, lang AS project, source || '/' || (doc_id % 50) AS name, md5(text) AS digest FROM documents"


@query(f"""WITH d AS ({_NAMED}), old AS (SELECT *, row_number() OVER (PARTITION BY project, name ORDER BY doc_id) AS version FROM d WHERE doc_id % 4 <> 3),
    one AS (SELECT project, digest, min(name) AS name FROM d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.project = d.project AND old.digest = d.digest) GROUP BY 1, 2),
    last AS (SELECT project, name, max(version) AS last FROM old GROUP BY 1, 2)
    SELECT project, name, digest, coalesce(last, 0) + row_number() OVER (PARTITION BY project, name ORDER BY digest) AS version FROM one LEFT JOIN last USING (project, name)""")
def ingest_versions(spark, folder):
    """Documents that arrive beside others: known and repeated contents are left out, new ones take their name's next version."""
    docs = load(spark, folder, "documents").select("doc_id", F.col("lang").alias("project"), F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.md5("text").alias("digest"))
    old = docs.where("doc_id % 4 <> 3").withColumn("version", F.row_number().over(Window.partitionBy("project", "name").orderBy("doc_id")))
    return maintenance.ingest(old, docs.where("doc_id % 2 = 1").drop("doc_id"), "project", "name", "digest")
