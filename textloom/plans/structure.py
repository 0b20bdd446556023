"""Chunks of structured documents, tables as text and as rows, and reads by statement, name and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import structure
from textloom.plans.documents import _quoted, _values
from textloom.plans.registry import query
from textloom.sources import tables
from textloom.sources.tables import load

_TABLES = [
    (1, ["Name", "Value"], [["pH", "7"], ["only one"], ["a", "b"]], "specification_table", None),
    (2, ["X"], [], "general", "Caption here"),
    (3, [], [["lost"]], None, ""),
    (4, ["A", "B", "C"], [["1", "2", "3"]], None, "Third"),
]


def _list(x) -> str:
    return "[" + ", ".join(_list(y) if isinstance(y, list) else _quoted(y) for y in x) + "]"


_TABLE_ROWS = ", ".join(f"({i}, {_list(h)}::VARCHAR[], {_list(r)}::VARCHAR[][], {_quoted(k)}, {_quoted(c)})" for i, h, r, k, c in _TABLES)


@query(f"""WITH t AS (SELECT * FROM (VALUES {_TABLE_ROWS}) v(id, h, r, k, c) UNION ALL SELECT 1000 + s_nationkey, ['key', 'name'], list([s_suppkey::VARCHAR, s_name] ORDER BY s_suppkey), 'general', NULL FROM supplier GROUP BY s_nationkey), l AS (SELECT id, unnest(r) AS cells, unnest(range(1, len(r) + 1)) AS n FROM t),
    b AS (SELECT id, string_agg('Row ' || n || ': ' || CASE WHEN len(cells) = len(h) THEN array_to_string(list_transform(list_zip(h, cells), lambda p: p[1] || ': ' || p[2]), '; ') ELSE array_to_string(cells, ' | ') END, chr(10) ORDER BY n) AS body FROM l JOIN t USING (id) GROUP BY id)
    SELECT id, CASE WHEN coalesce(c, '') <> '' THEN 'Table: ' || c ELSE CASE k WHEN 'specification_table' THEN 'Specification Table' WHEN 'general' THEN 'General' ELSE 'Table' END END
        || CASE WHEN len(h) > 0 AND len(r) > 0 THEN chr(10) || chr(10) || 'Headers: ' || array_to_string(h, ' | ') || chr(10) || chr(10) || 'Data:' || chr(10) || body ELSE '' END AS told,
        'Table (from markdown)' || CASE WHEN len(h) > 0 THEN chr(10) || 'Headers: ' || array_to_string(h, ' | ') ELSE '' END || CASE WHEN len(r) > 0 THEN chr(10) || 'Data:' || chr(10) || (SELECT string_agg('Row ' || n || ': ' || array_to_string(cells, ' | '), chr(10) ORDER BY n) FROM l WHERE l.id = t.id) ELSE '' END AS markdown
    FROM t LEFT JOIN b USING (id)""")
def table_texts(spark, folder):
    cells = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.array(s["s_suppkey"].cast("string"), s["s_name"]))
    listed = load(spark, folder, "supplier").groupBy("s_nationkey").agg(cells.alias("r"))  # a table a nation
    more = listed.select(1000 + F.col("s_nationkey"), F.array(F.lit("key"), F.lit("name")), "r", F.lit("general"), F.lit(None).cast("string"))
    rows = spark.createDataFrame(_TABLES, "id long, h array<string>, r array<array<string>>, k string, c string").union(more)
    return rows.select("id", structure.table_text(F.col("h"), F.col("r"), F.col("k"), F.col("c")).alias("told"), structure.markdown_text(F.col("h"), F.col("r")).alias("markdown"))


@query()
def section_chunks(spark, folder):
    """Documents as sections of paragraphs; packing is sequential, tested against plain Python."""
    rows = load(spark, folder, "documents").select("doc_id", F.lit(0).alias("place"), F.col("source").alias("title"), F.lit("general").alias("section_type"), F.lit(1).alias("page"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("content"))
    return structure.section_chunks(rows, "doc_id").select("doc_id", "part", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


_PIPES = "intro\n| Name | Value |\n|---|:--|\n| pH | 7 |\n| odd |\n| a | b |\n\ntext | x\n|P|Q|\n|1|2|\n| 3 | 4 |\nend"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1, {_quoted(_PIPES).replace(chr(10), "' || chr(10) || '")}), l AS (SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS line, unnest(range(len(string_split(t, chr(10))))) AS n FROM d),
    p AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l WHERE length(line) - length(replace(line, '|', '')) >= 2),
    t AS (SELECT *, min(n) OVER w AS first, first_value(line) OVER (w ORDER BY n) AS header, row_number() OVER (w ORDER BY n) - 1 AS place FROM p WINDOW w AS (PARTITION BY doc_id, run))
    SELECT doc_id, first::INTEGER AS first, place::INTEGER AS place, array_to_string(list_transform(string_split(header, '|')[2:-2], lambda x: trim(x)), ';') AS headers, array_to_string(list_transform(string_split(line, '|')[2:-2], lambda x: trim(x)), ';') AS cells
    FROM t WHERE place > 0 AND NOT (place = 1 AND regexp_full_match(line, '[|: -]+')) AND line LIKE '|%|' AND header LIKE '|%|' AND len(string_split(line, '|')) = len(string_split(header, '|'))""")
def pipe_table_rows(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, _PIPES)], "doc_id long, text string"))
    found = structure.pipe_rows(docs, "doc_id", "text")
    return found.select("doc_id", "first", "place", F.array_join("headers", ";").alias("headers"), F.array_join("cells", ";").alias("cells"))


_SAID = [(i, t) for i, t in enumerate(["5 kg of it", "pH 7", "12.5%w", "none", "3 °C then 4 m", "10mg/L", ""])]


@query(f"SELECT id, coalesce(regexp_extract(t, '\\d+(?:\\.\\d+)?\\s*([a-zA-Z%°µ/]+)', 1), '') AS unit, length(trim(t)) > 5 AS enough FROM (SELECT * FROM {_values(_SAID, 'id, t')} UNION ALL SELECT 1000 + doc_id, coalesce(text, '') FROM documents)")
def units_after_numbers(spark, folder):
    rows = spark.createDataFrame(_SAID, "id long, t string").union(load(spark, folder, "documents").select(1000 + F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return rows.select("id", structure.unit_after(F.col("t")).alias("unit"), structure.meaningful(F.col("t"), 5).alias("enough"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1")
def statement_rows(spark, folder):
    """A statement with named parameters over registered tables."""
    return tables.sql_rows(spark, folder, "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > :least GROUP BY 1", {"least": 250000.0})


@query("SELECT 'nation' AS name, true AS present, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'orders', true, (SELECT count(*) FROM orders) UNION ALL SELECT 'no_such_table', false, NULL")
def tables_present(spark, folder):
    """Which tables can be read, and the rows of those."""
    found = tables.present(spark, folder, ["nation", "orders", "no_such_table"])
    sizes = [load(spark, folder, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("nation", "orders")]
    return found.join(reduce(DataFrame.union, sizes), "name", "left")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def value_of_key(spark, folder):
    rows = load(spark, folder, "nation")
    most = rows.agg(F.max("n_name").alias("n_name"))  # one row
    return rows.join(most, "n_name", "left_semi").select("n_nationkey", "n_name")
