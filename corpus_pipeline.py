"""A training-data pipeline over documents: every stage works on what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep
the columns of documents, whatever their names, and leave out rows or, for
secrets, parts of texts. Defined results of every stage: null texts are empty
ones; rows whose doc_id is null are judged by their texts; repeated rows are
judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, packing, secret_scan, simhash_dedup, toxicity
from textloom.llm.frames import discard, shuffled, stored, table


def _marked(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns named by place, and (_d, _h): the id and the text's hash, by which decisions are carried to rows."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    places = docs.toDF(*names)
    text = F.coalesce(places[names[docs.columns.index("text")]], F.lit(""))
    return places.select("*", places[names[docs.columns.index("doc_id")]].cast("long").alias("_d"), F.xxhash64(text).alias("_h")), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that of the least id, null ids last, and then of the least text."""
    rows, names = _marked(docs)
    found = simhash_dedup.group(docs, with_hash=True)
    each = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))  # ids and hashes alone
    best = each.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("best"))
    # Written first: the join is used twice, and neither plan should hold the search for groups as well.
    kept = stored(best.select(F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash"), F.col("best.n").alias("_n")), "kept")
    joined = rows.join(shuffled(kept), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    # Rows are combined only where the kept one is repeated.
    repeated = joined.where("_n > 1").dropDuplicates(["_d", "_h"])
    return joined.where("_n = 1").select(*names).union(repeated.select(*names)).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, names = _marked(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    out = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return rows.join(shuffled(out), F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_anti").select(*names).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints and the packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again; what a stage has read goes then."""
    docs = whole = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if before is not whole:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
