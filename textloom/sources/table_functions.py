"""Searches and reports as table functions of SQL, called by name with parameters and defaults.

register() makes views of the given tables and functions over them, which live
as long as the session; a call is planned with its arguments in place, so
filters reach the scan, and the first rows are taken without sorting all.

Tables: vectors (chunk_id, document_id, chunk_text, page_number, embedding,
quality_score, document_type, project_id, status); entities (entity_id,
entity_type, entity_value, normalized_value, confidence, document_id,
project_id, status); usage (user_id, project_id, provider, model, api_type,
tokens, cost, quality, created). Other columns are carried by none.

Defined results: a null parameter sets no limit; null quality is 0.5, null
confidence 0, a null document type unknown; vectors that are null, of norm 0 or
of another length than the query's have no similarity and are left out; equal
rows are ordered by id, so repeated ones keep their number; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v)"
_LENGTH = f"sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('query_embedding', 'query_embedding')})"
_COSINE = f"{_DOT.format('embedding', 'query_embedding')} / nullif({_LENGTH}, 0D)"

#: Each function: its name, parameters, columns and rows.
FUNCTIONS = {
    "match_embeddings_enhanced": (
        "query_embedding ARRAY<FLOAT>, match_threshold DOUBLE DEFAULT 0.3, match_count INT DEFAULT 10, quality_threshold DOUBLE DEFAULT 0.0, project STRING DEFAULT NULL, document_types ARRAY<STRING> DEFAULT NULL",
        "chunk_id BIGINT, document_id BIGINT, chunk_text STRING, page_number INT, similarity DOUBLE, quality_score DOUBLE, document_type STRING",
        f"""SELECT chunk_id, document_id, chunk_text, page_number, similarity, quality_score, document_type FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, quality_score DESC, chunk_id) AS place FROM (
                SELECT chunk_id, document_id, chunk_text, page_number, {_COSINE} AS similarity,
                    coalesce(quality_score, 0.5D) AS quality_score, coalesce(document_type, 'unknown') AS document_type
                FROM vectors WHERE status = 'completed' AND (project IS NULL OR project_id = project) AND (document_types IS NULL OR array_contains(document_types, vectors.document_type)))
            WHERE similarity > match_threshold AND quality_score >= quality_threshold) WHERE place <= match_count""",
    ),
    "search_entities_enhanced": (
        "search_term STRING, entity_types ARRAY<STRING> DEFAULT NULL, project STRING DEFAULT NULL, confidence_threshold DOUBLE DEFAULT 0.0, include_normalized BOOLEAN DEFAULT true, match_count INT DEFAULT 20",
        "entity_id BIGINT, entity_type STRING, entity_value STRING, normalized_value STRING, confidence DOUBLE, document_id BIGINT, occurrences BIGINT",
        """SELECT entity_id, entity_type, entity_value, normalized_value, confidence, document_id, occurrences FROM (
            SELECT *, row_number() OVER (ORDER BY occurrences DESC, confidence DESC, entity_id) AS place FROM (
                SELECT e.*, n.occurrences FROM (SELECT entity_id, entity_type, entity_value, normalized_value, coalesce(confidence, 0D) AS confidence, document_id, coalesce(normalized_value, entity_value) AS name FROM entities
                    WHERE (contains(lower(entity_value), lower(search_term)) OR include_normalized AND contains(lower(normalized_value), lower(search_term))) AND (entity_types IS NULL OR array_contains(entity_types, entity_type))
                        AND (project IS NULL OR project_id = project) AND coalesce(confidence, 0D) >= confidence_threshold AND status = 'completed') e
                JOIN (SELECT coalesce(normalized_value, entity_value) AS name, count(*) AS occurrences FROM entities
                    WHERE (contains(lower(entity_value), lower(search_term)) OR include_normalized AND contains(lower(normalized_value), lower(search_term))) AND (entity_types IS NULL OR array_contains(entity_types, entity_type))
                        AND (project IS NULL OR project_id = project) AND coalesce(confidence, 0D) >= confidence_threshold AND status = 'completed' GROUP BY 1) n ON e.name = n.name)) WHERE place <= match_count""",
    ),
    "get_api_usage_stats": (
        "target_user BIGINT DEFAULT NULL, target_project STRING DEFAULT NULL, start_date TIMESTAMP DEFAULT now() - INTERVAL 30 DAYS, end_date TIMESTAMP DEFAULT now()",
        "provider STRING, api_type STRING, total_calls BIGINT, total_tokens BIGINT, total_cost DOUBLE, avg_tokens_per_call DOUBLE, avg_cost_per_call DOUBLE",
        """SELECT provider, api_type, count(*), sum(tokens), round(sum(cost), 6), round(avg(tokens), 2), round(avg(cost), 6) FROM usage
            WHERE (start_date IS NULL OR created >= start_date) AND (end_date IS NULL OR created <= end_date) AND (target_user IS NULL OR user_id = target_user) AND (target_project IS NULL OR project_id = target_project)
            GROUP BY provider, api_type""",
    ),
    "calculate_cost_efficiency": (
        "start_date TIMESTAMP DEFAULT now() - INTERVAL 7 DAYS, least_calls INT DEFAULT 5",
        "provider STRING, model STRING, api_type STRING, efficiency_score DOUBLE, cost_per_quality_point DOUBLE, recommendation STRING",
        """SELECT provider, model, api_type, CASE WHEN q > 0 THEN round(q / nullif(c * 1000, 0D), 4) ELSE 0D END, CASE WHEN q > 0 THEN round(c / q, 6) END,
            CASE WHEN q >= 0.8D AND c <= 0.001D THEN 'Highly Recommended' WHEN q >= 0.6D AND c <= 0.005D THEN 'Recommended' WHEN q >= 0.4D THEN 'Acceptable' ELSE 'Consider Alternatives' END
            FROM (SELECT provider, model, api_type, avg(quality) AS q, avg(cost) AS c FROM usage WHERE quality IS NOT NULL AND cost > 0 AND (start_date IS NULL OR created >= start_date) GROUP BY provider, model, api_type HAVING count(*) >= least_calls)""",
    ),
}


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Views of the tables, and the functions all of whose tables are among them."""
    needs = {"match_embeddings_enhanced": "vectors", "search_entities_enhanced": "entities", "get_api_usage_stats": "usage", "calculate_cost_efficiency": "usage"}
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    for name, (parameters, columns, rows) in FUNCTIONS.items():
        if needs[name] in tables:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {rows}")
