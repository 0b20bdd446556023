"""Table functions of SQL over the given tables, called with parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import query
from textloom.sources import table_functions
from textloom.sources.tables import load


def _vectors(spark, folder):
    at, label = F.col("vec_id"), F.col("label").cast("string")
    return load(spark, folder, "embeddings").select(
        at.alias("chunk_id"), (at / 4).cast("long").alias("document_id"), F.concat(F.lit("chunk "), at).alias("chunk_text"), (at % 4).cast("int").alias("page_number"), "embedding",
        F.when(at % 10 != 0, (at % 10) / 10).alias("quality_score"), F.when(at % 9 != 0, F.concat(F.lit("t"), label)).alias("document_type"), (at % 3).cast("string").alias("project_id"), F.when(at % 7 == 6, "failed").otherwise("completed").alias("status"),
    )


def _entities(spark, folder):
    at = F.col("p_partkey")
    return load(spark, folder, "part").select(
        at.alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("entity_value"), F.when(at % 2 == 0, F.upper("p_name")).alias("normalized_value"), F.when(at % 5 != 0, F.col("p_size") / 50).alias("confidence"),
        (at / 10).cast("long").alias("document_id"), F.col("p_brand").alias("project_id"), F.when(at % 11 == 5, "failed").otherwise("completed").alias("status"),
    )


def _usage(spark, folder):
    at = F.col("event_id")
    return load(spark, folder, "events").select(
        "user_id", (F.col("user_id") % 4).cast("string").alias("project_id"), F.concat(F.lit("p"), at % 3).alias("provider"), F.concat(F.lit("m"), at % 2).alias("model"), F.col("event_type").alias("api_type"), (at % 1000).alias("tokens"),
        (F.col("value") / 100000).alias("cost"), F.when(at % 5 != 0, (at % 5) / 4).alias("quality"), F.col("ts").cast("timestamp").alias("created"),
    )


_V = """SELECT vec_id AS chunk_id, vec_id // 4 AS document_id, 'chunk ' || vec_id AS chunk_text, (vec_id % 4)::INTEGER AS page_number, embedding, coalesce(CASE WHEN vec_id % 10 <> 0 THEN (vec_id % 10) / 10.0::DOUBLE END, 0.5) AS quality_score,
    CASE WHEN vec_id % 9 <> 0 THEN 't' || label END AS document_type, vec_id % 3 AS project_id FROM embeddings WHERE vec_id % 7 <> 6"""


@query(f"""SELECT chunk_id, document_id, chunk_text, page_number, round(s, 6) AS similarity, quality_score, document_type FROM (SELECT *, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM ({_V}))
    WHERE s > 0.05 AND quality_score >= 0.2 AND project_id = 1 AND document_type IN ('t0', 't1', 't2', 't3') ORDER BY s DESC, quality_score DESC, chunk_id LIMIT 15""")
def called_vector_search(spark, folder):
    vectors = _vectors(spark, folder)
    table_functions.register(spark, {"vectors": vectors})
    asked = vectors.where("chunk_id = 0").select("embedding").first()["embedding"]  # one vector, of which the call's plan is made
    call = f"match_embeddings_enhanced(array({', '.join(f'CAST({x!r}D AS FLOAT)' for x in asked)}), match_threshold => 0.05D, match_count => 15, quality_threshold => 0.2D, project => '1', document_types => array('t0', 't1', 't2', 't3'))"
    return spark.sql(f"SELECT * FROM {call}").withColumn("similarity", F.round("similarity", 6))


@query("""WITH e AS (SELECT p_partkey AS entity_id, p_type AS entity_type, p_name AS entity_value, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) END AS normalized_value, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0::DOUBLE END, 0) AS confidence, p_partkey // 10 AS document_id
    FROM part WHERE p_partkey % 11 <> 5 AND contains(lower(p_name), 'ring') AND p_type IN ('ECONOMY', 'PROMO', 'STANDARD')), m AS (SELECT *, count(*) OVER (PARTITION BY coalesce(normalized_value, entity_value)) AS occurrences FROM e WHERE confidence >= 0.1)
    SELECT * FROM m ORDER BY occurrences DESC, confidence DESC, entity_id LIMIT 20""")
def called_entity_search(spark, folder):
    table_functions.register(spark, {"entities": _entities(spark, folder)})
    return spark.sql("SELECT * FROM search_entities_enhanced('Ring', entity_types => array('ECONOMY', 'PROMO', 'STANDARD'), confidence_threshold => 0.1D)")


_U = "SELECT user_id, user_id % 4 AS project_id, 'p' || (event_id % 3) AS provider, 'm' || (event_id % 2) AS model, event_type AS api_type, event_id % 1000 AS tokens, value / 100000 AS cost, CASE WHEN event_id % 5 <> 0 THEN (event_id % 5) / 4.0::DOUBLE END AS quality, ts FROM events"


@query(f"""SELECT provider, api_type, count(*) AS total_calls, sum(tokens)::BIGINT AS total_tokens, round(sum(cost), 6) AS total_cost, round(avg(tokens), 2) AS avg_tokens_per_call, round(avg(cost), 6) AS avg_cost_per_call FROM ({_U})
    WHERE project_id = 2 AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-12-01 00:00:00' GROUP BY 1, 2""")
def called_usage(spark, folder):
    table_functions.register(spark, {"usage": _usage(spark, folder)})
    return spark.sql("SELECT * FROM get_api_usage_stats(target_project => '2', start_date => TIMESTAMP '2024-01-03 00:00:00', end_date => TIMESTAMP '2024-12-01 00:00:00')")


@query(f"""SELECT provider, model, api_type, CASE WHEN q > 0 THEN round(q / nullif(c * 1000, 0), 4) ELSE 0 END AS efficiency_score, CASE WHEN q > 0 THEN round(c / q, 6) END AS cost_per_quality_point,
    CASE WHEN q >= 0.8 AND c <= 0.001 THEN 'Highly Recommended' WHEN q >= 0.6 AND c <= 0.005 THEN 'Recommended' WHEN q >= 0.4 THEN 'Acceptable' ELSE 'Consider Alternatives' END AS recommendation
    FROM (SELECT provider, model, api_type, avg(quality) AS q, avg(cost) AS c FROM ({_U}) WHERE quality IS NOT NULL AND cost > 0 AND ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1, 2, 3 HAVING count(*) >= 5)""")
def called_cost_efficiency(spark, folder):
    table_functions.register(spark, {"usage": _usage(spark, folder)})
    return spark.sql("SELECT * FROM calculate_cost_efficiency(TIMESTAMP '2024-01-02 00:00:00')")
