"""Structured documents as chunks: tables told as text, sections packed by paragraphs, measures by group, plain text for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGE, PACK, LEAST = 2000, 1500, 50


def meaningful(text: Column, least: int = LEAST) -> Column:
    return F.length(F.btrim(text)) > least


def row_text(headers: Column, row: Column) -> Column:
    """"header: value" for each cell, or the cells alone where a row has more or fewer cells than there are headers."""
    pairs = F.array_join(F.zip_with(headers, row, lambda h, v: F.concat(h, F.lit(": "), F.coalesce(v, F.lit("None")))), "; ")
    return F.when(F.size(headers) == F.size(row), pairs).otherwise(F.array_join(row, " | "))


def table_text(headers: Column, rows: Column, table_type: Column, caption: Column) -> Column:
    """The caption, or else the type as a title; then headers and rows, if there are both."""
    title = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Table: "), caption)).otherwise(F.initcap(F.replace(F.coalesce(table_type, F.lit("Table")), F.lit("_"), F.lit(" "))))
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), row_text(headers, r)))
    body = F.concat(F.lit("\n\nHeaders: "), F.array_join(headers, " | "), F.lit("\n\nData:\n"), F.array_join(lines, "\n"))
    return F.concat(title, F.when((F.size(headers) > 0) & (F.size(rows) > 0), body).otherwise(F.lit("")))


def markdown_text(headers: Column, rows: Column) -> Column:
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("\nRow "), (i + 1).cast("string"), F.lit(": "), F.array_join(r, " | ")))
    head = F.when(F.size(headers) > 0, F.concat(F.lit("\nHeaders: "), F.array_join(headers, " | "))).otherwise(F.lit(""))
    return F.concat(F.lit("Table (from markdown)"), head, F.when(F.size(rows) > 0, F.concat(F.lit("\nData:"), F.array_join(lines, ""))).otherwise(F.lit("")))


def packed(content: Column, large: int = LARGE, size: int = PACK) -> Column:
    """A section's chunks: the whole if it isn't large, else its paragraphs, packed while they stay below size together."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, para: Column) -> Column:
        fits = F.length(F.concat(acc["now"], para)) < size
        flushed = F.when(fits | (F.btrim(acc["now"], F.lit(" \n\t\r")) == ""), acc["done"]).otherwise(F.array_append(acc["done"], F.btrim(acc["now"], F.lit(" \n\t\r"))))
        return F.struct(flushed.alias("done"), F.concat(F.when(fits, acc["now"]).otherwise(F.lit("")), para, F.lit("\n\n")).alias("now"))

    def finish(acc: Column) -> Column:
        rest = F.btrim(acc["now"], F.lit(" \n\t\r"))
        return F.when(rest == "", acc["done"]).otherwise(F.array_append(acc["done"], rest))

    return F.when(F.length(content) > large, F.aggregate(F.split(content, "\n\n"), start, step, finish)).otherwise(F.array(content))


def section_chunks(sections: DataFrame, key: str) -> DataFrame:
    """(key, place, title, section_type, page, part, text) of sections (key, place, title, section_type, page, content); short chunks are left out."""
    each = sections.select(key, "place", "title", "section_type", "page", F.posexplode(packed(F.coalesce("content", F.lit("")))).alias("part", "text"))
    return each.where(meaningful(F.col("text")))


def pipe_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per table row of pipe tables: (key, first, place, cells by header), for rows as wide as the header.

    A table is neighbouring lines of two pipes or more, its first line the
    header, a line of rules after that passed over; lines are told apart by
    their place, so tables need no loop.
    """
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "raw")).select(key, "n", F.btrim("raw").alias("line"))
    piped = lines.where(F.regexp_count("line", F.lit("[|]")) >= 2)
    own = Window.partitionBy(key).orderBy("n")
    runs = piped.withColumn("run", F.col("n") - F.row_number().over(own))
    within = Window.partitionBy(key, "run").orderBy("n")
    told = runs.withColumns({"first": F.min("n").over(Window.partitionBy(key, "run")), "header": F.first("line").over(within), "at": F.row_number().over(within) - 1})
    cells = lambda c: F.transform(F.slice(F.split(c, "[|]"), 2, F.greatest(F.size(F.split(c, "[|]")) - 2, F.lit(0))), lambda x: F.btrim(x))
    whole = lambda c: F.startswith(c, F.lit("|")) & F.endswith(c, F.lit("|"))
    rule = (F.col("at") == 1) & F.col("line").rlike("^[|: -]+$")
    kept = told.where((F.col("at") > 0) & ~rule & whole(F.col("line")) & whole(F.col("header")) & (F.size(cells(F.col("line"))) == F.size(cells(F.col("header")))))
    return kept.select(key, "first", F.col("at").alias("place"), cells(F.col("header")).alias("headers"), cells(F.col("line")).alias("cells"))


def unit_after(text: Column) -> Column:
    """The unit that follows the first number, empty without one."""
    return F.regexp_extract(text, r"\d+(?:\.\d+)?\s*([a-zA-Z%°µ/]+)", 1)
