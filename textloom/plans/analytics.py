"""Usage, cost, vector and graph reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import cost, graph, search
from textloom.plans.registry import query
from textloom.sources.tables import load

NOW = "2024-01-31 00:00:00"
_TOKENS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


def _query_vector(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


_SIMILAR = """SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


@query(f"SELECT vec_id, label, round(s, 6) AS similarity FROM ({_SIMILAR}) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, folder):
    found = search.similar(load(spark, folder, "embeddings"), _query_vector(spark, folder))
    return search.top_k(found, 10, F.desc("similarity"), "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, label, round(s, 6) AS similarity FROM ({_SIMILAR}) WHERE s > 0.1 AND label IN (0, 1, 2) ORDER BY s DESC, vec_id LIMIT 20")
def vector_topk_threshold(spark, folder):
    rows = load(spark, folder, "embeddings").where(F.col("label").isin(0, 1, 2))
    found = search.similar(rows, _query_vector(spark, folder)).where("similarity > 0.1")
    return search.top_k(found, 20, F.desc("similarity"), "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, label, round(s, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id)::INTEGER AS place FROM ({_SIMILAR}) QUALIFY place <= 3")
def vector_topk_by_label(spark, folder):
    found = search.similar(load(spark, folder, "embeddings"), _query_vector(spark, folder))
    return search.top_k_per(found, "label", 3, F.desc("similarity"), "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "place")


@query(f"""SELECT event_type, count(*) AS total_calls, sum({_TOKENS})::BIGINT AS total_tokens, round(sum(value), 4) AS total_cost,
    round(avg({_TOKENS}), 2) AS avg_tokens, round(avg(value), 6) AS avg_cost FROM events GROUP BY event_type""")
def usage_stats(spark, folder):
    return _events(spark, folder).groupBy("event_type").agg(
        F.count("*").alias("total_calls"), F.sum("tokens").alias("total_tokens"), F.round(F.sum("value"), 4).alias("total_cost"), F.round(F.avg("tokens"), 2).alias("avg_tokens"), F.round(F.avg("value"), 6).alias("avg_cost")
    )


@query(f"SELECT user_id, count(*) AS calls, sum({_TOKENS})::BIGINT AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY user_id")
def usage_by_user(spark, folder):
    return _events(spark, folder).groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("value"), 4).alias("cost"))


@query(f"""SELECT count(*) AS calls, sum({_TOKENS})::BIGINT AS tokens, round(sum(value), 4) AS cost, count(DISTINCT user_id) AS users,
    CASE WHEN sum({_TOKENS}) > 0 THEN round(sum(value) / sum({_TOKENS}) * 1000, 6) ELSE 0 END AS cost_per_1k FROM events""")
def usage_totals(spark, folder):
    per_1k = F.coalesce(F.round(F.try_divide(F.sum("value"), F.sum("tokens")) * 1000, 6), F.lit(0.0))
    return _events(spark, folder).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("value"), 4).alias("cost"), F.countDistinct("user_id").alias("users"), per_1k.alias("cost_per_1k"))


@query(f"""SELECT event_type, user_id, count(*) AS calls, round(avg({_TOKENS}) / (avg(value) * 1000), 6) AS efficiency,
    CASE WHEN avg(value) < 20 AND avg({_TOKENS}) >= 50 THEN 'optimal' WHEN avg(value) < 20 THEN 'cheap' WHEN avg({_TOKENS}) >= 50 THEN 'costly' ELSE 'review' END AS recommendation
    FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY event_type, user_id HAVING count(*) >= 5""")
def cost_efficiency(spark, folder):
    """Quality per cost of the last week, groups of five calls or more; costs are summed exactly, so that ties don't hang on the order of rows."""
    recent = _events(spark, folder).where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAY"))
    spent, known = cost.total(F.col("value")), F.count("value")
    good, cheap = F.avg("tokens") >= 50, spent < 20 * known
    efficiency = F.try_divide(F.sum("tokens"), spent * 1000) * F.try_divide(known, F.count("tokens"))
    groups = recent.groupBy("event_type", "user_id").agg(
        F.count("*").alias("calls"),
        F.round(efficiency, 6).alias("efficiency"),
        F.when(cheap & good, "optimal").when(cheap, "cheap").when(good, "costly").otherwise("review").alias("recommendation"),
    )
    return groups.where("calls >= 5")


@query("""SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
    count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def daily_usage_pivot(spark, folder):
    types = ["click", "error", "purchase", "signup", "view"]
    return load(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", types).count().na.fill(0)


@query("SELECT ts::DATE AS day, event_type, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2")
def daily_cost_by_type(spark, folder):
    return load(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1")
def monthly_counts(spark, folder):
    return load(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_orders"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("SELECT event_type, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def cost_share(spark, folder):
    sums = load(spark, folder, "events").groupBy("event_type").agg(F.sum("value").alias("cost"))
    return sums.select("event_type", F.round(F.col("cost") / F.sum("cost").over(Window.partitionBy()), 6).alias("share"))


_DAILY = "SELECT day, cost, row_number() OVER (ORDER BY day) - 1 AS n FROM (SELECT ts::DATE AS day, sum(value) AS cost FROM events GROUP BY 1)"


def _daily(spark, folder) -> DataFrame:
    """Cost per day with its number; days are few whatever the events."""
    days = load(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("cost"))
    return days.withColumn("n", F.row_number().over(Window.orderBy("day")) - 1)


@query(f"SELECT round(regr_slope(cost, n), 6) AS slope, round(regr_intercept(cost, n), 6) AS intercept, round(avg(cost) * 30, 4) AS month_estimate FROM ({_DAILY})")
def cost_trend(spark, folder):
    return _daily(spark, folder).agg(F.round(F.regr_slope("cost", "n"), 6).alias("slope"), F.round(F.regr_intercept("cost", "n"), 6).alias("intercept"), F.round(F.avg("cost") * 30, 4).alias("month_estimate"))


@query(f"""WITH d AS ({_DAILY}), fit AS (SELECT regr_slope(cost, n) AS a, regr_intercept(cost, n) AS b, max(n) AS last, max(day) AS day FROM d)
    SELECT (day + i::INTEGER)::DATE AS day, round(b + a * (last + i), 4) AS cost, true AS projected FROM fit, range(1, 31) r(i)
    UNION ALL SELECT day, round(cost, 4), false FROM d""")
def cost_projection_30d(spark, folder):
    daily = _daily(spark, folder)
    fit = daily.agg(F.regr_slope("cost", "n").alias("a"), F.regr_intercept("cost", "n").alias("b"), F.max("n").alias("last"), F.max("day").alias("day"))
    ahead = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("i"))
    future = ahead.select(F.date_add("day", F.col("i")).alias("day"), F.round(F.col("b") + F.col("a") * (F.col("last") + F.col("i")), 4).alias("cost"), F.lit(True).alias("projected"))
    return future.unionByName(daily.select("day", F.round("cost", 4).alias("cost"), F.lit(False).alias("projected")))


@query(f"SELECT event_type, round(avg(value * 1000 / nullif({_TOKENS}, 0)), 4) AS cost_per_1k, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY event_type")
def per_1k_cost(spark, folder):
    return _events(spark, folder).groupBy("event_type").agg(F.round(F.avg(F.try_divide(F.col("value") * 1000, F.col("tokens"))), 4).alias("cost_per_1k"), F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("""SELECT least(20, greatest(1, floor(value / 25)::INTEGER + 1))::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1""")
def confidence_histogram(spark, folder):
    """Twenty bins from 0 to 500, values outside in the end bins."""
    place = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.col("value") / 25).cast("int") + 1)).cast("long")
    return load(spark, folder, "events").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT p_type, p_name, n, place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name)::INTEGER AS place
    FROM (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2)) WHERE place <= 20""")
def top20_values_per_type(spark, folder):
    counts = load(spark, folder, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return search.top_k_per(counts, "p_type", 20, F.desc("n"), "p_name")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_head(spark, folder):
    return load(spark, folder, "events").orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "ts", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_2_of_rows(spark, folder):
    return load(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag AS mode, count(*) AS n, round(avg(l_quantity), 6) AS avg_quantity, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS fallbacks, round(sum(avg(l_quantity) * count(*)) OVER () / sum(count(*)) OVER (), 6) AS overall FROM lineitem GROUP BY 1")
def mode_stats(spark, folder):
    """Per mode counts with a conditional sum, and the mean over all weighted by them."""
    every = Window.partitionBy()
    groups = load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("fallbacks"))
    return groups.select("mode", "n", F.round("a", 6).alias("avg_quantity"), "fallbacks", F.round(F.sum(F.col("a") * F.col("n")).over(every) / F.sum("n").over(every), 6).alias("overall"))


_ENDS = "SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem GROUP BY ALL"


def _edges(spark, folder) -> DataFrame:
    return load(spark, folder, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("b")).distinct()


@query(f"""WITH e AS ({_ENDS}), d AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n)
    SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(2 * (sum(degree) / 2) / count(*), 6) AS avg_degree, round(2 * (sum(degree) / 2) / (count(*) * (count(*) - 1)), 9) AS density FROM d""")
def graph_metrics(spark, folder):
    return graph.metrics(_edges(spark, folder), "a", "b")


@query(f"WITH e AS ({_ENDS}) SELECT n AS node, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n ORDER BY degree DESC, node LIMIT 10")
def graph_degree_top10(spark, folder):
    return search.top_k(graph.degrees(_edges(spark, folder), "a", "b"), 10, F.desc("degree"), "node")


@query("""SELECT 'node' AS kind, p_type AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def graph_type_distribution(spark, folder):
    nodes = load(spark, folder, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    edges = load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return nodes.union(edges)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, c_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey),
    u AS (SELECT 'c' || a AS a, 'n' || b AS b FROM e UNION SELECT 'n' || b, 'c' || a FROM e),
    h1 AS (SELECT b AS node FROM u WHERE a = 'n0'), h2 AS (SELECT DISTINCT b AS node FROM u JOIN h1 ON u.a = h1.node WHERE b <> 'n0' AND b NOT IN (SELECT node FROM h1))
    SELECT 'n0' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def graph_two_hop(spark, folder):
    """Least steps from one nation over customers with orders."""
    big = load(spark, folder, "orders").select("o_custkey").distinct().join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    one = big.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b")).distinct()
    both = one.union(one.select("b", "a"))
    return graph.reachable(both, spark.createDataFrame([("n0",)], "node string"), "a", "b", 2)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)""")
def graph_valid_edges(spark, folder):
    edges = load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts, suppliers = load(spark, folder, "part").where("p_size > 45").select(F.col("p_partkey").alias("k")), load(spark, folder, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("k"))
    half = graph.valid_edges(edges.withColumn("same", F.col("l_partkey")), parts, "l_partkey", "same", "k")
    return graph.valid_edges(half.withColumn("same", F.col("l_suppkey")), suppliers, "l_suppkey", "same", "k").select("l_orderkey", "l_linenumber")


_PRICES = [(0, "view", 0.15, 0.6), (1, "click", 2.5, 10.0), (2, "c", 1.0, 2.0), (3, "signup", 0.5, 1.5)]


@query(f"""WITH p(ordinal, name, i, o) AS (VALUES {', '.join(map(str, _PRICES))}),
    m AS (SELECT event_id, {_TOKENS} * 1000 AS tokens, i, o, row_number() OVER (PARTITION BY event_id ORDER BY ordinal NULLS LAST) AS n FROM events LEFT JOIN p ON contains(event_type, name))
    SELECT event_id, tokens, round(coalesce((floor(tokens * 0.7::DOUBLE) * i::DOUBLE + (tokens - floor(tokens * 0.7::DOUBLE)) * o::DOUBLE) / 1e6, tokens * 5.0::DOUBLE / 1e6), 9) AS cost_usd FROM m WHERE n = 1""")
def model_cost(spark, folder):
    usage = _events(spark, folder).select("event_id", "event_type", (F.col("tokens") * 1000).alias("tokens"))
    return usage.select("event_id", "tokens", cost.priced(F.col("event_type"), F.col("tokens"), _PRICES, 5.0).alias("cost_usd"))


@query("SELECT o_orderpriority AS entity_type, count(*) AS entities, count(DISTINCT o_custkey) AS sources, round(avg(o_totalprice), 4) AS avg_confidence FROM orders GROUP BY 1")
def entity_summary(spark, folder):
    return load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("entity_type")).agg(F.count("*").alias("entities"), F.countDistinct("o_custkey").alias("sources"), F.round(F.avg("o_totalprice"), 4).alias("avg_confidence"))


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total_cost FROM events GROUP BY 1, 2""")
def windowed_usage(spark, folder):
    """The streaming usage report run over a finished table."""
    from textloom.streaming.events import usage_by_window

    rows = usage_by_window(load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n_events", "total_cost")
