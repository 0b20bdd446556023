"""How the filters of a corpus act on each other, by replaying every order of them.

Each document gets one flag a filter. The flags are crossed with all orders of
the filters (a broadcast table, 120 rows for five filters), the steps of an
order are exploded, the first step that fails a document is worked out, and
sums under conditions are combined before the shuffle. Documents of equal flags,
part and labels are one row with a count by then, so the cross is of profiles
with orders and doesn't grow with the documents: a part has 128 profiles at most.

Whether a text occurs under a smaller id is decided table-wide on digests of
the texts. Copies are counted by (digest, part, labels) before the shuffle, so a
text that a third of all documents hold is a few rows.

Defined results: a null text is an empty one and a null lang the part ''; a
document without id has no smaller one, no labels, and is no one's smaller one;
repeated rows of one id count each and aren't copies of each other; an id that
any label row marks counts as marked; null labels mark nothing; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick

_SPACES = r"[\x20\x09-\x0D]+"


def text_flags(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, symbols."""
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def _marks(labels: DataFrame) -> DataFrame:
    """(id, other: 0, good, toxic), one row an id."""
    rows = pick(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").try_cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL")
    return rows.groupBy("id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]).withColumn("other", F.lit(0).cast("long"))


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails: one boolean for each of A to E, good, toxic, n): documents counted by what replays alike."""
    rows = pick(docs, "doc_id", "text", "lang").select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    worded = rows.withColumn("words", F.array_remove(F.split("text", _SPACES), ""))
    slim = worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), F.array(*text_flags(F.col("text"), F.col("words"))).alias("fails"))
    # Rows without id match no label; their second key deals them out by text.
    slim = slim.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), F.when(F.col("doc_id").isNull(), F.xxhash64("key").bitwiseOR(F.lit(1))).otherwise(0).alias("other"))
    marked = slim.join(_marks(labels), ["id", "other"], "left").fillna(False, ["good", "toxic"])
    each = marked.groupBy("id", "other", "doc_id", "key", "part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    counted = each.groupBy("key", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("none"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    kept = F.col("none") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = counted.withColumn("kept", kept).select("part", "fails", "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias("copy"), F.col("kept").alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - F.col("kept")).alias("n")))).alias("e"))
    whole = split.select("part", F.concat("fails", F.array("e.copy")).alias("fails"), "good", "toxic", F.col("e.n").alias("n")).where("n > 0")
    return whole.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def replay(profiles: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row for each part, filter_order and step: what each filter removes there, and what others removed before it.

    profiles: (part, fails: a boolean for each of names, good, toxic, n). There
    are as many orders as permutations of the names, so keep these few.
    """
    listed = [("".join(names[i] for i in p), list(p)) for p in permutations(range(len(names)))]
    orders = F.broadcast(profiles.sparkSession.createDataFrame(listed, "filter_order string, filters array<int>").coalesce(1))
    failing = F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda s: F.get("fails", F.get("filters", s - 1)))
    crossed = profiles.crossJoin(orders).withColumn("first", F.coalesce(F.array_min(failing), F.lit(len(names) + 1)))
    only = F.size(F.filter("fails", lambda f: f)) == 1
    steps = crossed.select("part", "filter_order", "first", "good", "toxic", "n", "fails", only.alias("only"), F.posexplode("filters").alias("at", "filter"))
    steps = steps.select("*", (F.col("at") + 1).alias("step"), F.get("fails", F.col("filter")).alias("failed"))
    here = F.col("first") == F.col("step")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    summed = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("first") > F.col("step")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("failed") & (F.col("first") < F.col("step"))).alias("redundant"),
        total(F.col("failed") & F.col("only")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    return summed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of filters A to E over documents, by their lang."""
    return replay(profiles(docs, labels))
