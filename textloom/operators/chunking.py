"""Splitting and parsing documents: paragraphs, recursive splits, sections, tables."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, squeezed


def paragraphs(docs: DataFrame, key: str, text: str, mark: str = "\n\n", *more: str) -> DataFrame:
    """Other named columns are carried along. Blank parts are left out, their places still counted; a part has its page guess out of three to a page."""
    parts = docs.select(key, *more, F.posexplode(F.split(text, mark)).alias("chunk_order", "chunk_text"))
    parts = parts.withColumn("chunk_text", F.trim("chunk_text")).where("chunk_text <> ''")
    return parts.withColumn("page_number", F.expr("chunk_order div 3 + 1").cast("int"))


MARKS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, a: int, b: int, mark: str) -> list[int]:
    """Where the pieces of text[a:b] begin, and b: each occurrence of the mark opens one; without a mark each character does."""
    if not mark:
        return list(range(a, b + 1))
    found = [m.start() for m in re.compile(re.escape(mark)).finditer(text, a, b)]
    return [a, *(found[1:] if found and found[0] == a else found), b]


def _joined(borders: list[int], size: int, overlap: int):
    """Neighbouring pieces as runs of at most size characters, each run taking up the last pieces of the one before, of at most overlap in all."""
    first, end = 0, len(borders) - 1
    while first < end:
        last = max(first + 1, bisect_right(borders, borders[first] + size) - 1)
        yield borders[first], borders[last]
        if last == end:
            return
        first = min(last, bisect_left(borders, max(borders[last] - overlap, borders[last + 1] - size)))


def _split(text: str, a: int, b: int, size: int, overlap: int, marks: tuple[str, ...]):
    """Runs of pieces by the first mark that occurs; a piece of the whole size or more is split by the marks after it."""
    n = next((i for i, m in enumerate(marks) if not m or text.find(m, a, b) != -1), len(marks) - 1)
    borders = _pieces(text, a, b, marks[n])
    small = borders[:1]
    for x, y in zip(borders, borders[1:]):
        if y - x < size:
            small.append(y)
            continue
        yield from _joined(small, size, overlap)
        if marks[n] and marks[n + 1 :]:
            yield from _split(text, x, y, size, overlap, marks[n + 1 :])
        else:
            yield x, y
        small = [y]
    yield from _joined(small, size, overlap)


def _trimmed(text: str, a: int, b: int) -> list[tuple[int, str]]:
    piece = text[a:b]
    return [(a + len(piece) - len(piece.lstrip()), piece.strip())] if piece.strip() else []


def split_text(text: str, size: int = 1200, overlap: int = 50, marks: tuple[str, ...] = MARKS) -> list[tuple[int, str]]:
    """(start, piece), trimmed: pieces between marks, joined up to size characters; a mark stays with what follows it."""
    return [p for a, b in _split(text, 0, len(text), size, overlap, marks) for p in _trimmed(text, a, b)]


def split_around(text: str, entities: list[tuple[int, int, bool]], size: int = 1200, overlap: int = 50) -> list[tuple[int, str]]:
    """(start, piece), trimmed: pieces of about size characters that don't cut compounds, entities being (start, end, compound).

    Where the first entity at a cut is a compound, the cut moves to its nearer end; a
    piece of under half the size then runs on to the next sentence, if that comes
    within one and a half sizes, else to the plain size. A cut that wouldn't move on
    is made at the plain size. Without entities the text is split by marks.
    """
    if not entities:
        return split_text(text, size, overlap)
    out, live, n = [], [], len(text)
    coming = sorted(entities, key=lambda e: e[0], reverse=True)
    at = start = 0
    while at < n:
        plain = min(at + size, n)
        while coming and coming[-1][0] <= plain:
            live.append(coming.pop())
        live = [e for e in live if e[1] >= plain]
        cut = plain
        if live and live[0][2]:
            a, b, _ = live[0]
            cut = a if plain - a < b - plain else b
        if cut < n and cut - start < size // 2:
            sentence = text.find(". ", cut, start - (-3 * size // 2) + 1)
            cut = plain if sentence == -1 else sentence + 2
        cut = cut if cut > at else plain
        out += _trimmed(text, start, cut)
        if cut >= n:
            break
        start, at = max(start, cut - overlap), cut
    return out


def split_documents(docs: DataFrame, key: str, text: str, size: int = 1200, overlap: int = 50, entities: str | None = None) -> DataFrame:
    """(key, chunk_order, start, chunk_text), Arrow batches at a time.

    entities names an array of (start, end, compound) structs that cuts go around;
    null ones are none, and those without places are passed over.
    """
    kind = docs.schema[key].dataType.simpleString()

    def of(text, found):
        placed = [(e["start"], e["end"], bool(e["compound"])) for e in found or [] if e and e["start"] is not None and e["end"] is not None]
        return split_around(text or "", placed, size, overlap)

    def run(batches):
        for batch in batches:
            held = [c.to_pylist() for c in batch.columns]
            rows = [(k, i, a, t) for k, x, *e in zip(*held) for i, (a, t) in enumerate(of(x, e[0] if e else None))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], names=[key, "chunk_order", "start", "chunk_text"])

    return docs.select(key, text, *([entities] if entities else [])).mapInArrow(run, f"{key} {kind}, chunk_order int, start int, chunk_text string")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(docs: DataFrame, key: str, text: str, header: str = "^([0-9]+\\. .*|#+ .*|[A-Z][A-Z0-9 !,.-]{3,})$") -> DataFrame:
    """Lines gathered under the header line before them: gaps and islands by line number."""
    marked = lines(docs, key, text).withColumn("is_header", F.col("line").rlike(header).cast("int"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("section_no", F.sum("is_header").over(w))
    return placed.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("is_header") == 1, F.col("line"))).alias("title"),
        F.count(F.when(F.col("is_header") == 0, 1)).alias("n_lines"),
        F.sum(F.when(F.col("is_header") == 0, F.length("line")).otherwise(0)).alias("n_chars"),
    )


def pipe_tables(docs: DataFrame, key: str, text: str, pipes: int = 2) -> DataFrame:
    """Runs of lines with more than so many pipes: first line, length, columns and header of each."""
    rows = lines(docs, key, text).where(F.regexp_count("line", F.lit("\\|")) > pipes)
    run = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return (
        rows.withColumn("run", run)
        .groupBy(key, "run")
        .agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"), F.min_by(F.regexp_count("line", F.lit("\\|")) + 1, "line_no").alias("n_columns"), F.min_by(squeezed(F.col("line")), "line_no").alias("header"))
        .drop("run")
    )


def structure(text) -> dict:
    """Columns that describe a text's build."""
    count = F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))
    return {
        "n_chars": F.length(text),
        "n_words": count,
        "n_paragraphs": F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")),
        "n_sentences": F.regexp_count(text, F.lit("[.!?]( |\n|$)")),
        "reading_minutes": F.greatest(F.lit(1), F.round(count / 200).cast("int")),
        "special_share": F.round(F.regexp_count(text, F.lit("[#$%&*|<>]")) / F.greatest(F.length(text), F.lit(1)), 6),
    }
