"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits within ``2`` bits of each other are cut into two
segments, one of which then differs by at most one bit. Each segment is indexed
once per wildcard bit; fingerprints with an equal variant are compared. Only
distinct fingerprints take part, so copies cost nothing.

A variant shared by more than ``bucket`` fingerprints is not compared in pairs:
its fingerprints are indexed again under sixteen four-bit segments, of which
fourteen must agree. Such a key leaves eight bits open, so 256 fingerprints at
most can share it, and no link is lost.

Defined results: a null text is an empty one; a text without words has
fingerprint zero, linked like any other; null doc_ids keep a fingerprint and
are passed over as component ids; repeated rows come back once each; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import documents_of, map_batches, shuffled, stored

BITS, REACH = 64, 2


def fingerprint(text: str, size: int = 3) -> int:
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a bounded block of bits at a time
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint as a signed 64-bit number."""
    run = lambda cols: {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": [fingerprint(t) for t in cols["text"]]}
    return map_batches(documents_of(docs).withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for both halves and each wildcard bit, the half with that bit cleared."""
    key = "shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, cast(i div 32 as int) * 32) & 4294967295L & ~shiftleft(1L, cast(i % 32 as int)))"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("i")).select(F.expr(key).alias("key"), "fp")


def _fine_variants(fps: DataFrame, width: int = 4) -> DataFrame:
    """(key, mask, fp): for each pair of narrow segments, the fingerprint with both cleared."""
    ones = (1 << width) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(((1 << 64) - 1) ^ (ones << width * a) ^ (ones << width * b)) for a, b in combinations(range(BITS // width), REACH)]
    return fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select(F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "mask", "fp")


def _pairs(variants: DataFrame, *key: str) -> DataFrame:
    """Linked pairs within the groups of a key, whose sizes are bounded."""
    groups = variants.groupBy(*key).agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    near = f"transform(fps, (x, i) -> struct(x AS a, filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {REACH}) AS near))"
    one = groups.select(F.explode(F.expr(f"filter({near}, p -> size(p.near) > 0)")).alias("p"))
    return one.select("p.a", F.explode("p.near").alias("b"))


def links(fps: DataFrame, bucket: int = 48) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within reach, some more than once."""
    variants = _variants(fps)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = variants.join(shuffled(sizes), "key")
    small = _pairs(shared.where(F.col("n") <= bucket), "key")
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    return small.union(_pairs(_fine_variants(crowded), "mask", "key"))


def group(docs: DataFrame, bucket: int = 48, task_fps: int = 16_384, with_hash: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach).

    With with_hash also text_hash and group, a number of the component that holds
    for rows without any id too.

    Distinct fingerprints are few bytes but 64 variants each, so they are dealt
    out ``task_fps`` to a task before that.
    """
    fps = stored(fingerprints(docs), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tasks = max(1, math.ceil(nodes.count() / task_fps))
    roots = components(links(nodes.select("fp").repartition(tasks, "fp"), bucket), "a", "b").withColumnsRenamed({"node": "fp"})
    placed = nodes.join(shuffled(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.join(shuffled(best), "root").select("fp", "component_id", F.col("root").alias("group"))
    more = ["text_hash", "group"] if with_hash else []
    return fps.join(shuffled(found), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *more)
