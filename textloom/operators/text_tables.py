"""Tables in running text: lines with a separator whose columns agree, and JSON objects that hold a table.

Defined results: null and empty texts have no tables; repeated rows of one key
are one text to separated_tables(), which needs keys that tell texts apart, and
give their tables again in json_tables(); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.chunking import lines

#: Separators of columns, in the order in which they win ties (fixed values).
SEPARATORS = ["|", "\t", ",", "  "]
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def times(text: Column, part: str) -> Column:
    """How often part stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def separated_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, first_line, separator, headers, rows) of runs of two lines and more.

    A line takes part if it has two of one separator and three words. The run's
    separator is the one by which all its lines have as many columns, most
    columns first; a run without one is no table, but counts in table_no.
    """
    line = F.col("line")
    each = lines(docs, key, text).withColumn("line", stripped(line))
    words = F.size(F.filter(F.split(line, f"{SPACE}+"), lambda w: w != ""))
    counts = {f"n{i}": times(line, s) for i, s in enumerate(SEPARATORS)}
    rows = each.withColumns(counts).where((F.greatest(*counts) >= 2) & (words >= 3))
    own = Window.partitionBy(key).orderBy("line_no")  # the lines of one text
    runs = rows.withColumn("run", F.col("line_no") - F.row_number().over(own)).groupBy(key, "run").agg(
        F.min("line_no").alias("first_line"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]).alias("lines"),
        *[F.when(F.min(n) == F.max(n), F.min(n) + 1).alias(n) for n in counts],
    )
    runs = runs.withColumn("table_no", F.row_number().over(Window.partitionBy(key).orderBy("first_line")))
    options = F.array(*[F.struct((-F.coalesce(F.col(n), F.lit(0))).alias("columns"), F.lit(i).alias("at"), F.lit(s).alias("separator")) for i, (n, s) in enumerate(zip(counts, SEPARATORS))])
    best = F.array_min(options)
    told = runs.where(F.size("lines") > 1).withColumn("best", best).where(F.col("best.columns") < -1)
    cells = lambda x: F.filter(F.transform(F.split(x, F.concat(F.lit(r"\Q"), F.col("best.separator"), F.lit(r"\E"))), stripped), lambda c: c != "")
    split = told.withColumn("cells", F.filter(F.transform("lines", cells), lambda r: F.size(r) > 0)).where(F.size("cells") > 1)
    return split.select(key, "table_no", "first_line", F.col("best.separator").alias("separator"), F.get("cells", F.lit(0)).alias("headers"), F.slice("cells", 2, F.size("cells") - 1).alias("rows"))


_MARKS = re.compile(r'[{}"\\]')


def json_spans(text: str) -> list[tuple[int, int]]:
    """Places of the outermost balanced braces, in one pass; braces in strings don't count, and an object that is never closed gives those closed inside it."""
    opened: list[int] = []
    found: list[tuple[int, int]] = []
    quoted, skip = False, -1
    for m in _MARKS.finditer(text):
        at, mark = m.start(), m[0]
        if at == skip or not opened and mark != "{":
            continue
        if mark == "\\":
            skip = at + 1 if quoted else skip
        elif mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark == "{":
            opened.append(at)
        else:
            start = opened.pop()
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, at + 1))
    return found


def json_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, table_type, headers, rows, caption) of JSON objects with a type, headers and rows in the text."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, t[a:b]) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, (a, b) in enumerate(json_spans(t))]
            keys, at, said = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(said, pa.string())], [key, "at", "said"])

    named = docs.select(key, text).where(F.contains(text, F.lit('"table_type"')))
    spans = named.mapInArrow(run, f"{key} {kind.simpleString()}, at int, said string")
    read = F.from_json("said", "table_type string, headers array<string>, rows array<array<string>>, caption string, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    whole = spans.withColumn("t", read).where("t._bad IS NULL AND t.table_type IS NOT NULL AND t.headers IS NOT NULL AND t.rows IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))  # the tables of one text
    return whole.select(key, place.alias("table_no"), "t.table_type", "t.headers", "t.rows", F.coalesce("t.caption", F.lit("")).alias("caption"))
