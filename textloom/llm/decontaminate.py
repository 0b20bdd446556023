"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Words are taken from both tables; each window of ``window`` words is
represented by its least k-gram hash, so any window that a document shares with
an item is found by joining these fingerprints. A hit is extended to the whole
window and compared word by word, so hash collisions do no harm. Items shorter
than a window are one window each, of their own length, with their own whole
hash as fingerprint.

The item side is broadcast only while its counted rows are at most
``broadcast_rows``. Beyond that, fingerprints are joined by shuffle as slim
rows, and only documents with a hit are read again to be extended.

Defined results: null and wordless texts have no words and no hits; wordless
items have no window; an item without id can mark words but isn't listed;
repeated rows come back once each; null doc_ids stay null; an empty benchmark
marks nothing, an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII but digits and, once lowered, letters parts words.
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    # lower() would also change letters beyond ASCII; for a text of ASCII alone it is the same and cheaper.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _PARTS), "")


def _grams(words: str, size: int) -> Column:
    """Hashes of all runs of that many words; single words are taken out, since slice() outside generated code copies the array."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct windows: (words, size, fp, at: place of the fingerprint's gram from 0, items: ids)."""
    rows = pick(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = rows.select("item_id", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    distinct = each.groupBy("words", "size").agg(F.collect_set("item_id").alias("items"))
    hashed = distinct.withColumn("g", F.when(F.col("size") < window, F.array(F.xxhash64("words"))).otherwise(_grams("words", gram)))
    return hashed.select("words", "size", "items", F.array_min("g").alias("fp"), (F.array_position("g", F.array_min("g")) - 1).cast("int").alias("at"))


def _spread(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per document with fp null, and one per winnowed gram: (doc_id, text_hash, w, fp, p: its place from 1).

    Of each window the leftmost least gram is kept, once: the window's least is
    a new one if it has just entered, or if the gram that left was the least
    before. Apart from the hashes themselves this runs in generated code, and a
    document's words are copied for rows that meet an item alone.
    """
    span = window - gram + 1
    hashed = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("w")).select("*", _grams("w", gram).alias("g"))
    each = hashed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("g") - span + 1, F.lit(0)))).alias("i"))
    part = F.slice("g", F.greatest(F.col("i"), F.lit(1)), span)
    least = each.withColumn("m", F.array_min(part)).withColumn("p", F.col("i") + F.array_position(part, F.col("m")).cast("int") - 1)
    new = (F.col("i") <= 1) | (F.col("p") == F.col("i") + (span - 1)) | (F.get("g", F.col("i") - 2) <= F.col("m"))
    return least.where(new).select("doc_id", "text_hash", "w", F.when(F.col("i") > 0, F.col("m")).alias("fp"), "p")


def _spread_short(rows: DataFrame, size: int) -> DataFrame:
    """One row per run of that many words, for items shorter than a window."""
    worded = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("w")).where(F.size("w") >= size)
    each = worded.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("p"))
    return each.select("doc_id", "text_hash", "w", F.xxhash64(F.slice("w", F.col("p"), size)).alias("fp"), "p")


def _met(rows: DataFrame, windows: DataFrame, how: str = "inner") -> DataFrame:
    """Rows whose whole window stands in the document, with its span of words; with a left join, documents too."""
    start = F.col("p") - F.col("at")
    same = F.when(start >= 1, F.slice("w", start, F.col("size")) == F.col("words"))
    joined = rows.join(windows, "fp", how).where(F.col("fp").isNull() | same)
    span = F.when(F.col("fp").isNotNull(), F.struct(start.alias("a"), (start + F.col("size")).alias("b")))
    return joined.select("doc_id", "text_hash", F.when(F.col("fp").isNull(), F.size("w")).alias("n"), span.alias("span"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items: the ids as sorted strings."""
    windows = stored(item_windows(items, window, gram), "windows")
    small = windows.count() <= broadcast_rows
    short = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # fewer than window values
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def of_size(n: int) -> DataFrame:
        own = windows.where(F.col("size") == n)
        return F.broadcast(own) if small else own

    spread = _spread(rows, window, gram)
    if small:
        hits = _met(spread, of_size(window), "left")
        looked = rows
    else:
        slim = spread.select("doc_id", "text_hash", "fp", F.when(F.col("fp").isNull(), F.size("w")).alias("n"))
        for n in short:
            slim = slim.union(_spread_short(rows, n).select("doc_id", "text_hash", "fp", F.lit(None).cast("int").alias("n")))
        every = slim.where("fp IS NULL").select("doc_id", "text_hash", "n", F.lit(None).cast("struct<a:int,b:int>").alias("span"), F.lit(None).cast("array<string>").alias("items"))
        found = slim.where("fp IS NOT NULL").distinct().join(windows.select("fp").distinct(), "fp", "left_semi").select("doc_id", "text_hash").distinct()
        found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
        looked = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi").distinct()
        hits = every.union(_met(_spread(looked, window, gram).where("fp IS NOT NULL"), of_size(window)))
    for n in short:
        hits = hits.union(_met(_spread_short(looked, n), of_size(n)))

    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_words"),
        F.count("n").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Spans sorted by start: each adds the words beyond the furthest end so far.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"))
    counted = by_doc.withColumn("n_hit", F.aggregate("spans", start, step)["n"].cast("long"))
    return counted.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
        "text_hash",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
