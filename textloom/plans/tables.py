"""Tables in the documents and in texts with each kind of separator and of JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import text_tables
from textloom.plans.registry import query
from textloom.sources.tables import load

TEXTS = [
    (-1, "Results\nname | amount | unit\nsalt | 5 | g\n | sugar pure | 10 | mg |\n\nafter"),
    (-2, "a b|c|d\ne f|g|h\n| x y | z | w\nplain text here\nname, amount of, unit\nsalt, 5, g fine\n"),
    (-3, "one\ttwo words\tthree\nfour\tfive\tsix seven\r\neight\tnine more\tten"),
    (-4, "name  amount  unit of\nsalt  5  g\nsugar  10  mg and more"),
    (-5, "a, b, c | d | e f\ng, h, i | j | k l"),
    (-6, "ragged, one, two words\nragged, one, two, three words"),
    (-7, "| | | \n| | | |\n, , , a\n, , , b"),
    (-8, 'Before {"table_type": "lab", "headers": ["a", "b"], "rows": [["1", "2"], ["{3}", "\\"}"]], "meta": {"x": {"y": 1}}} after {"table_type": "x"} and {open {"table_type": "n", "headers": [], "rows": [], "caption": "c"}'),
    (-9, "single line, of, words only"),
    (-10, ""),
    (-11, None),
]


def _rows(spark, folder):
    return load(spark, folder, "documents").select("doc_id", "text").union(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def _quoted(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_S = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
_STRIP = lambda x: rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_COUNT = lambda s: f"((length(line) - length(replace(line, {s}, ''))) // length({s}))"


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(t)})" for i, t in TEXTS)}) AS v(doc_id, text)),
    l AS (SELECT doc_id, i - 1 AS line_no, {_STRIP("parts[i]")} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
    c AS (SELECT *, {_COUNT("'|'")} AS n0, {_COUNT("chr(9)")} AS n1, {_COUNT("','")} AS n2, {_COUNT("'  '")} AS n3 FROM l),
    r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c
        WHERE greatest(n0, n1, n2, n3) >= 2 AND len(list_filter(regexp_split_to_array(line, '{_S}+'), lambda w: w <> '')) >= 3),
    g AS (SELECT doc_id, min(line_no) AS first_line, list(line ORDER BY line_no) AS lines,
        CASE WHEN min(n0) = max(n0) THEN min(n0) ELSE 0 END AS c0, CASE WHEN min(n1) = max(n1) THEN min(n1) ELSE 0 END AS c1,
        CASE WHEN min(n2) = max(n2) THEN min(n2) ELSE 0 END AS c2, CASE WHEN min(n3) = max(n3) THEN min(n3) ELSE 0 END AS c3 FROM r GROUP BY doc_id, run),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS table_no, greatest(c0, c1, c2, c3) AS most,
        CASE greatest(c0, c1, c2, c3) WHEN c0 THEN '|' WHEN c1 THEN chr(9) WHEN c2 THEN ',' ELSE '  ' END AS separator FROM g),
    t AS (SELECT *, list_filter(list_transform(lines, lambda x: list_filter(list_transform(string_split(x, separator), lambda y: {_STRIP("y")}), lambda y: y <> '')), lambda x: len(x) > 0) AS cells FROM b WHERE len(lines) > 1 AND most > 0)
    SELECT doc_id, table_no::INTEGER AS table_no, first_line::INTEGER AS first_line, separator, array_to_string(cells[1], ' / ') AS headers, len(cells[1])::INTEGER AS n_columns,
        array_to_string(list_transform(cells[2:], lambda x: array_to_string(x, ' / ')), chr(10)) AS rows FROM t WHERE len(cells) > 1""")
def separated_tables(spark, folder):
    found = text_tables.separated_tables(_rows(spark, folder), "doc_id", "text")
    joined = F.array_join(F.transform("rows", lambda r: F.array_join(r, " / ")), "\n")
    return found.select("doc_id", "table_no", "first_line", "separator", F.array_join("headers", " / ").alias("headers"), F.size("headers").alias("n_columns"), joined.alias("rows"))


@query()
def json_tables(spark, folder):
    """Nested JSON has no place in SQL's patterns: tested against plain Python."""
    return text_tables.json_tables(_rows(spark, folder), "doc_id", "text")
