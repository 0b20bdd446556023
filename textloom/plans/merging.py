"""One entity for each cluster of parts with its metadata, and entities from cut-off answers about the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import clusters, model_answers
from textloom.plans.registry import query
from textloom.sources.tables import load

#: Parts with ties, nulls and no metadata: (cluster, value, confidence, brand, sizes) (stated rows).
STATED = [("-tie", "b one", 5.0, "B1", "1,2"), ("-tie", "a one", 5.0, None, None), ("-tie", "b one", 1.0, "B1", "2,2"), ("-null", None, None, "B2", None), ("-null", "only", None, None, "7"), ("-nothing", None, 1.0, None, None)]


def _rows(spark, folder):
    parts = load(spark, folder, "part")
    group = F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1))
    own = parts.select(group.alias("cluster"), F.col("p_name").alias("v"), (F.col("p_retailprice") / 2000).alias("c"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"), F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_size") % 3).cast("string")).alias("sizes"))
    rows = own.union(spark.createDataFrame(STATED, "cluster string, v string, c double, brand string, sizes string"))
    said = F.map_from_arrays(F.array(F.lit("brand"), F.lit("size")), F.array(F.array("brand"), F.split("sizes", ",")))
    return rows.withColumn("metadata", F.when(F.col("brand").isNotNull(), said))


_FIXED = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in STATED)
_R = f"""(SELECT p_type || ' ' || split_part(p_name, ' ', 1) AS cluster, p_name AS v, p_retailprice / 2000 AS c, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS brand, p_size || ',' || (p_size % 3) AS sizes FROM part
    UNION ALL SELECT cluster, v, c::DOUBLE, brand, sizes FROM (VALUES {_FIXED}) AS s(cluster, v, c, brand, sizes))"""


@query(f"""SELECT cluster, trim(regexp_replace((list(v ORDER BY coalesce(c, 0) DESC, v) FILTER (v IS NOT NULL))[1], '\\s+', ' ', 'g'), ' .,;:') AS entity_value,
    CASE WHEN count(v) > 0 THEN round(least(max(coalesce(c, 0)) FILTER (v IS NOT NULL), 0.9), 6)::DOUBLE END AS confidence, count(*) AS size, count(DISTINCT v) AS mentions FROM {_R} GROUP BY cluster""")
def merged_entities(spark, folder):
    found = clusters.merged(_rows(spark, folder), ["cluster"], "v", "c", F.lit("OTHER"), F.lit(0.9))
    return found.withColumn("confidence", F.round("confidence", 6))


@query(f"""SELECT cluster, key, value, count(*) AS times FROM (
    SELECT cluster, 'brand' AS key, brand AS value FROM {_R} WHERE brand IS NOT NULL
    UNION ALL SELECT cluster, 'size', unnest(string_split(sizes, ',')) FROM {_R} WHERE brand IS NOT NULL
    UNION ALL SELECT cluster, 'original_mentions', v FROM {_R} WHERE v IS NOT NULL) GROUP BY ALL""")
def merged_metadata(spark, folder):
    return clusters.merged_lists(_rows(spark, folder), ["cluster"], "v", "metadata")


def _answers(spark, folder):
    """Each document's sentences as entities of one answer, cut off after a share of its length told by the key."""
    docs = load(spark, folder, "documents")
    none = lambda c: F.coalesce(c, F.lit(""))
    said = F.transform(F.split(none("text"), "[.\\n]"), lambda s: F.to_json(F.struct(none("lang").alias("type"), s.alias("value"), none("source").alias("context"))))
    whole = F.concat(F.lit('{"entities":['), F.array_join(said, ","), F.lit('],"relationships":[]}'))
    share = F.expr("CAST(length(answer) * (doc_id % 11) DIV 10 AS INT)")
    return docs.select("doc_id", whole.alias("answer")).select("doc_id", F.substr("answer", F.lit(1), share).alias("answer"))


@query("""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_split_to_array(coalesce(text, ''), '[.\\n]') AS parts FROM documents),
    s AS (SELECT doc_id, lang, source, unnest(parts) AS v, unnest(range(1, len(parts) + 1)) AS i FROM d),
    l AS (SELECT *, 17 + length(to_json(lang)) + length(to_json(v)) AS value_end, 28 + length(to_json(lang)) + length(to_json(v)) + length(to_json(source)) AS context_end FROM s),
    p AS (SELECT *, 13 + sum(context_end + 2) OVER (PARTITION BY doc_id ORDER BY i) - (context_end + 2) AS start, 13 + sum(context_end + 2) OVER (PARTITION BY doc_id) - 1 + 21 AS whole FROM l),
    c AS (SELECT *, whole * (doc_id % 11) // 10 AS cut FROM p)
    SELECT doc_id, CASE WHEN cut = 0 THEN 'none' WHEN cut >= whole THEN 'whole' ELSE 'closed' END AS state, count(*) FILTER (start + value_end <= cut) AS n_entities,
        count(*) FILTER (start + context_end <= cut AND source <> '') AS n_contexts, coalesce(sum(length(v)) FILTER (start + value_end <= cut), 0)::BIGINT AS value_chars
    FROM c GROUP BY doc_id, cut, whole""")
def recovered_answers(spark, folder):
    found = model_answers.recovered(_answers(spark, folder), "doc_id", "answer")
    n = lambda c: F.size(c).cast("long")
    chars = F.aggregate("entities", F.lit(0).cast("long"), lambda a, e: a + F.length(e["value"]))
    return found.select("doc_id", "state", n(F.col("entities")).alias("n_entities"), n(F.filter("entities", lambda e: e["context"] != "")).alias("n_contexts"), chars.alias("value_chars"))
