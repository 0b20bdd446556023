"""Functions called from SQL: rows, defaults, lateral calls, and filters that reach the scan."""

import pytest
from oracle import compare
from textloom.plans import called, registry
from textloom.sources import table_functions


@pytest.mark.parametrize("name", ["called_vector_search", "called_entity_search", "called_usage", "called_cost_efficiency"])
def test_against_sql(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    assert df.count() > 0 and compare(df, registry.oracle_sql()[name], folder) is None


def test_defaults(spark):
    """Without dates, the reports cover the last thirty and seven days."""
    rows = [(1, "p", "m", 10, 0.002, 0.5, days) for days in (0, 1, 2, 3, 4, 5, 20, 40)] + [(2, "p", "n", None, None, None, 1)]
    made = spark.createDataFrame(rows, "user_id long, provider string, model string, tokens long, cost double, quality double, days int")
    usage = made.selectExpr("*", "'a' AS api_type", "CAST(NULL AS STRING) AS project_id", "now() - make_dt_interval(days, 0, 1) AS created")
    table_functions.register(spark, {"usage": usage})
    assert [tuple(r) for r in spark.sql("SELECT * FROM get_api_usage_stats(1)").collect()] == [("p", "a", 7, 70, 0.014, 10.0, 0.002)]
    assert spark.sql("SELECT * FROM get_api_usage_stats(start_date => NULL, end_date => NULL)").first()["total_calls"] == 9
    assert [tuple(r) for r in spark.sql("SELECT * FROM calculate_cost_efficiency()").collect()] == [("p", "m", "a", 0.25, 0.004, "Acceptable")]


def test_calls(spark, folder):
    table_functions.register(spark, {"vectors": called._vectors(spark, folder), "entities": called._entities(spark, folder)})
    found = spark.sql("SELECT t.term, f.occurrences FROM VALUES ('ring'), ('widget'), ('absent') AS t(term), LATERAL search_entities_enhanced(t.term, match_count => 3) f").collect()
    assert sorted(r["term"] for r in found) == ["ring"] * 3 + ["widget"] * 3
    plan = spark.sql("SELECT * FROM search_entities_enhanced('ring', project => 'Brand#13', match_count => 3)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_brand,Brand#13)" in plan and "TakeOrderedAndProject" in plan
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    rest = "document_id long, chunk_text string, page_number int, quality_score double, document_type string, project_id string"
    for column in rest.split(", "):
        odd = odd.selectExpr("*", f"CAST(NULL AS {column.split()[1]}) AS {column.split()[0]}")
    odd = odd.selectExpr("*", "'completed' AS status", "1 AS similarity", "2 AS place")
    table_functions.register(spark, {"vectors": odd})
    ask = "SELECT chunk_id, similarity, quality_score, document_type FROM match_embeddings_enhanced(array(1F, 0F))"
    assert [tuple(r) for r in spark.sql(ask).collect()] == [(4, 1.0, 0.5, "unknown")] * 2
    table_functions.register(spark, {"vectors": odd.limit(0)})
    assert spark.sql(ask).count() == 0
