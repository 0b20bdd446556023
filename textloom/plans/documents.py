"""Kinds of documents, sections, tables and measures; each query over the tables and rows that reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import document_types as kinds
from textloom.plans.registry import query
from textloom.sources.tables import load


def _said(steps) -> list[str]:
    """A text for each term of a ladder, one with all first terms, and one with none."""
    return [f"On this Page: {t.upper() if i % 2 else t} and more" for _, terms in steps for i, t in enumerate(terms)] + [" ".join(t[0] for _, t in steps), "nothing of it", ""]


def _upload_texts() -> list[str]:
    out = ["plain words"]
    for opens, inside, _ in kinds.UPLOAD_TEXT:
        out += [f"The {o}." for o in opens] + [f"The {opens[0]} with {t}" for _, ts in inside for t in ts]
    return out


_FILES = [t for steps in (kinds.GENERAL_NAME, kinds.PRODUCT_NAME, kinds.CATEGORIES) for _, ts in steps for t in ts] + kinds.AGRICULTURAL_NAMES
_TEXTS = [*_said(kinds.GENERAL_TEXT), *_said(kinds.FOOD_TEXT), *_upload_texts(), *_said(kinds.MERGED), "corn and wheat", "corn, wheat and soil ph", "a yield", *(" and ".join(t[:2]) for _, t in kinds.CATEGORIES)]
_TEXTS += [p.replace(r"\s+", "  ").replace(r"\b", " ") for ps in kinds.PRODUCT_TEXT.values() for p in ps] + ["brochure brochure safety data sheet"]
#: (id, text, file name, preset type): ids below zero stand beside the documents.
ROWS = [(-1 - i, t, None, None) for i, t in enumerate(_TEXTS)] + [(-1001 - i, "plain words of a page", f"My_{n.title()}.pdf", None) for i, n in enumerate(_FILES)]
ROWS += [(-2001, None, None, None), (-2002, "a contract", "sds.pdf", "recipe"), (-2003, "", "", None)]


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({names}))"


_DOCS_SQL = f"(SELECT doc_id, coalesce(lower(text), '') AS t, coalesce(lower(source), '') AS f, NULL AS preset FROM documents UNION ALL SELECT doc_id, coalesce(lower(t), ''), coalesce(lower(f), ''), preset FROM {_values(ROWS, 'doc_id, t, f, preset')})"


def _rows(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text", F.col("source").alias("filename"), F.lit(None).cast("string").alias("preset"))
    return docs.union(spark.createDataFrame(ROWS, "doc_id long, text string, filename string, preset string"))


def _any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(t)})" for t in terms) + ")"


def _case(column: str, steps, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {_any(column, t)} THEN {_quoted(n)}' for n, t in steps)} ELSE {_quoted(default)} END"


def _count(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, {_quoted(t)})::INTEGER" for t in terms) + ")"


@query(f"""SELECT doc_id, coalesce(preset, CASE WHEN {_count('t', kinds.AGRICULTURAL_WORDS)} >= 3 OR {_any('f', kinds.AGRICULTURAL_NAMES)} THEN 'agricultural'
    {' '.join(f"WHEN {_any('t', t)} THEN '{n}'" for n, t in kinds.GENERAL_TEXT)} {' '.join(f"WHEN {_any('f', t)} THEN '{n}'" for n, t in kinds.GENERAL_NAME)} ELSE 'general' END) AS doc_type FROM {_DOCS_SQL}""")
def document_type_general(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.general(F.col("text"), F.col("filename"), F.col("preset")).alias("doc_type"))


def _matches(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(t, {_quoted(p)}))" for p in patterns)


_TYPES = list(kinds.PRODUCT_TEXT)


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN {_any('f', t)} THEN '{n}'" for n, t in kinds.PRODUCT_NAME)} WHEN greatest({', '.join(_TYPES)}) = 0 THEN 'TECHNICAL_DATASHEET'
    {' '.join(f"WHEN {n} = greatest({', '.join(_TYPES)}) THEN '{n}'" for n in _TYPES)} END AS doc_type
    FROM (SELECT *, {', '.join(f'{_matches(ps)} AS {n}' for n, ps in kinds.PRODUCT_TEXT.items())} FROM {_DOCS_SQL})""")
def document_type_product(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.product(F.col("text"), F.col("filename")).alias("doc_type"))


@query(f"SELECT doc_id, {_case('t', kinds.FOOD_TEXT, 'FOOD_DATASHEET')} AS doc_type FROM {_DOCS_SQL}")
def document_type_food(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.food(F.col("text")).alias("doc_type"))


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN {_any('t', opens)} THEN {_case('t', inside, other) if inside else _quoted(other)}" for opens, inside, other in kinds.UPLOAD_TEXT)} ELSE 'TECHNICAL_SPECIFICATION' END AS doc_type FROM {_DOCS_SQL}""")
def document_type_upload(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.upload(F.col("text")).alias("doc_type"))


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN {_any('f', t)} THEN '{n}'" for n, t in kinds.CATEGORIES)} {' '.join(f"WHEN {_count('t', t)} >= 2 THEN '{n}'" for n, t in kinds.CATEGORIES)} ELSE 'general_document' END AS category FROM {_DOCS_SQL}""")
def document_category(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.category(F.col("text"), F.col("filename")).alias("category"))


@query(f"SELECT doc_id, {_case('t', kinds.MERGED, 'unknown')} AS classification FROM {_DOCS_SQL}")
def document_classification(spark, folder):
    return _rows(spark, folder).select("doc_id", kinds.first_of(F.col("text"), kinds.MERGED, "unknown").alias("classification"))


_TITLES = [(i, t) for i, t in enumerate(_said(kinds.SECTIONS))]


@query(f"SELECT id, title, {_case('lower(title)', kinds.SECTIONS, 'general')} AS section_type FROM (SELECT * FROM {_values(_TITLES, 'id, title')} UNION ALL SELECT 1000 + doc_id, substr(text, 1, 60) FROM documents)")
def section_types(spark, folder):
    heads = load(spark, folder, "documents").select(1000 + F.col("doc_id"), F.substring("text", 1, 60))
    return spark.createDataFrame(_TITLES, "id long, title string").union(heads).withColumn("section_type", kinds.first_of(F.col("title"), kinds.SECTIONS, "general"))


_HEADS = [(i, t) for i, t in enumerate(_said(kinds.TABLES))]


@query(f"SELECT id, headers, {_case('lower(headers)', kinds.TABLES, 'general')} AS table_type FROM (SELECT * FROM {_values(_HEADS, 'id, headers')} UNION ALL SELECT 1000 + doc_id, substr(text, 61, 60) FROM documents)")
def table_types(spark, folder):
    heads = load(spark, folder, "documents").select(1000 + F.col("doc_id"), F.substring("text", 61, 60))
    return spark.createDataFrame(_HEADS, "id long, headers string").union(heads).withColumn("table_type", kinds.first_of(F.col("headers"), kinds.TABLES, "general"))


_SPECS = [(i // 7, i, t, str(i), "g" if i % 3 else None) for i, t in enumerate([x for _, ts in kinds.MEASURES for x in ts] + ["other thing", ""])]


@query(f"""WITH s AS (SELECT *, {_case('lower(parameter)', kinds.MEASURES, 'other')} AS grp FROM (SELECT * FROM {_values(_SPECS, 'doc_id, place, parameter, val, unit')} UNION ALL SELECT 1000 + p_size, p_partkey, p_name, p_size::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'mm' END FROM part))
    SELECT doc_id, grp, count(*) AS specs, string_agg(parameter || ': ' || val || coalesce(' ' || unit, ''), chr(10) ORDER BY place) AS told FROM s GROUP BY 1, 2""")
def specification_groups(spark, folder):
    """Measures of a document by group, each group told as text."""
    parts = load(spark, folder, "part").select(1000 + F.col("p_size"), "p_partkey", "p_name", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "mm"))
    rows = spark.createDataFrame(_SPECS, "doc_id long, place long, parameter string, val string, unit string").union(parts)
    line = F.concat(F.col("parameter"), F.lit(": "), F.col("val"), F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")))
    named = rows.withColumn("grp", kinds.first_of(F.col("parameter"), kinds.MEASURES, "other")).withColumn("line", F.struct("place", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list("line")), lambda x: x["line"])
    return named.groupBy("doc_id", "grp").agg(F.count("*").alias("specs"), F.array_join(lines, "\n").alias("told"))


_ASKED = [(-1 - i, t) for i, t in enumerate([f"a {w} {ws[0]}" for ws in kinds.SHARES.values() for w in ws] + ["crop law food", "", None])]
_SHARE = {k: f"{_count('t', v)} / {len(v)}.0::DOUBLE" for k, v in kinds.SHARES.items()}


@query(f"""WITH q AS (SELECT conv_id, turn, coalesce(lower(text), '') AS t FROM conversations UNION ALL SELECT id, 0, coalesce(lower(t), '') FROM {_values(_ASKED, 'id, t')}),
    s AS (SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in _SHARE.items())} FROM q)
    SELECT conv_id, turn, {', '.join(f"round(CASE WHEN {' + '.join(_SHARE)} > 0 THEN {k} / ({' + '.join(_SHARE)}) ELSE 0.33 END, 6) AS {k}" for k in _SHARE)} FROM s""")
def domain_shares(spark, folder):
    more = spark.createDataFrame(_ASKED, "conv_id long, text string").select("conv_id", F.lit(0).cast("long").alias("turn"), "text")
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "text").union(more)
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in kinds.domain_shares(F.col("text")).items()])
