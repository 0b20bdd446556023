"""Phrases that occur often and whose parts seldom occur apart, by language.

Two passes over the texts, each in blocks of bounded size. The first adds up a
sketch: phrases of one to four words are hashed to cells, each block's counts of
cells are shuffled by ranges of cells and summed, and a cell's sum is an upper
bound for every phrase in it. Only one bit a cell comes back: whether the bound
reaches ``least``. In the second pass the phrases of a block whose own cell and
whose parts' cells have that bit are its candidates; they are compiled into an
Aho-Corasick automaton, guarded by a space at both ends so that words match
whole, and the block is scanned for all matches, overlaps included. The exact
counts of all blocks are summed and the thresholds applied.

Every phrase that reaches ``least`` is a candidate in each block that holds it,
so counts are exact; the sketch only spares counting others. Its cells grow with
the text up to 2 ** ``most_bits`` (a broadcast of 64 MB); beyond that bounds
get looser and more phrases are counted, with the same result. Automata hold the
candidates of one block, so neither the driver nor a task holds all phrases.

Defined results: a null text is an empty one, a null lang is ``und``; repeated
rows count each; an empty table gives no rows; other columns, whatever their
names, are ignored; a phrase that stands more than once in a longer one is
compared with it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, sliced, stored

LONGEST = 4
#: Bytes of text in a block.
BLOCK = 16 << 20
#: Cells in a range, whose places take two bytes.
RANGE = 1 << 16
#: The floor of twice a phrase's share of its parts, in millionths, in decimals that no count overflows.
SCORE = "cast(a AS decimal(20, 0)) * 2000000 div (cast(l AS decimal(20, 0)) + r)"
#: A-Z lowered; every mark between pieces becomes a full stop, which no word holds; tabs become spaces.
_MARKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _MARKS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_MARKS) + b" ")


def words_of(text: str) -> list[bytes]:
    """Words in order, with a full stop between pieces."""
    return text.encode().translate(_TABLE).replace(b".", b" . ").split()


class _Numbers(dict):
    """Words numbered as they come; 0 is the full stop."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Texts of one language: words as numbers with a 0 between pieces and texts, and the texts with single spaces."""

    def __init__(self, lang: str):
        self.seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))
        self.numbers, self.parts, self.texts = _Numbers({b".": 0}), [], []

    def add(self, text: str) -> None:
        words = words_of(text)
        if words:
            self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
            self.texts.append(" %s " % b" ".join(words).decode())

    def close(self) -> None:
        gap = np.zeros(1, np.int32)
        self.ids = np.concatenate(list(chain.from_iterable((p, gap) for p in self.parts)) or [gap])
        self.parts = []

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1 to LONGEST words: a hash for each first word's place, and whether a phrase stands there."""
        own = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in self.numbers), np.uint64, len(self.numbers))[self.ids]
        is_word = self.ids > 0
        h, valid = np.full(len(self.ids), self.seed), np.ones(len(self.ids), bool)
        for n in range(1, LONGEST + 1):
            size = max(0, len(self.ids) - n + 1)
            h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 : n - 1 + size]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            valid = valid[:size] & is_word[n - 1 : n - 1 + size]
            yield h, valid


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Block]]:
    """Blocks by language, of BLOCK bytes together."""
    found, size = {}, 0
    for batch in sliced(batches, 64):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in found:
                found[lang] = Block(lang)
            found[lang].add(text)
            size += len(text)
        if size >= BLOCK:
            yield found
            found, size = {}, 0
    if found:
        yield found


def _cells(block: Block, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    block.close()
    for h, valid in block.hashes():
        yield (h >> np.uint64(64 - bits)).astype(np.uint32), valid


def sketch(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """A packed bit for each of 2 ** bits cells: whether its phrases together occur ``least`` times."""
    kind = np.uint8 if least <= 255 else np.uint32  # counts beyond least say no more
    size, ranges = RANGE, (1 << bits) // RANGE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _blocks(batches):
            cells, n = np.unique(np.concatenate([c[valid] for block in found.values() for c, valid in _cells(block, bits)]), return_counts=True)
            ends = np.searchsorted(cells, np.arange(ranges + 1, dtype=np.uint64) * size)
            places, n = (cells % size).astype(np.uint16), np.minimum(n, least).astype(kind)
            held = [r for r in range(ranges) if ends[r] < ends[r + 1]]
            cut = lambda a: pa.array([a[ends[r] : ends[r + 1]].tobytes() for r in held], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), cut(places), cut(n)], ["range", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(r, np.zeros(size, np.int64))
                held[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, kind)
                np.minimum(held, least, out=held)
        bits_of = [np.packbits(s >= least).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits_of, pa.binary())], ["range", "bits"])

    counted = rows.mapInArrow(count, "range int, places binary, counts binary")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges // 128, 1)
    summed = counted.repartition(min(tasks, ranges), "range").mapInArrow(add, "range int, bits binary")
    out = np.zeros((ranges, size // 8), np.uint8)
    for r in summed.toLocalIterator():  # 2 ** bits / 8 bytes in all
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def candidates(block: Block, bits: int, marks: np.ndarray) -> list[str]:
    """The phrases of a block whose cells, and whose parts' cells, reach the bound."""
    words = [w.decode() for w in block.numbers]
    found, before, ranks = [], None, None
    for n, (cells, valid) in enumerate(_cells(block, bits), 1):
        ok = valid & ((marks[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
        if before is not None:
            ok &= before[: len(ok)] & before[1 : len(ok) + 1]
        at = np.flatnonzero(ok)
        # A phrase is told by the number of its first words and its last word: exact, without strings.
        last = block.ids[at + n - 1].astype(np.int64)
        key = last if n == 1 else (ranks[at] << 32) | last
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        ranks = np.zeros(len(ok), np.int64)
        ranks[at] = number
        found += [" ".join([words[i] for i in block.ids[p : p + n]]) for p in at[first]]
        before = ok
    return found


def scan(texts: list[str], phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs, overlaps included."""
    machine = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        machine.add_word(f" {p} ", i)
    machine.make_automaton()
    hits = np.fromiter(map(itemgetter(1), chain.from_iterable(map(machine.iter, texts))), np.int32)
    return np.bincount(hits, minlength=len(phrases))


def phrase_counts(docs: DataFrame, least: int = 30, most_bits: int = 29) -> DataFrame:
    """(lang, phrase, size: its words, n), of all phrases of 1 to 4 words that occur ``least`` times; a row of phrase '' and size 0 has the words of a lang."""
    rows = pick(docs, "text", "lang").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(16, math.ceil(math.log2(size / 16 + 1))))
    marks = rows.sparkSession.sparkContext.broadcast(sketch(rows, bits, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _blocks(batches):
            for lang, block in found.items():
                phrases = candidates(block, bits, marks.value)
                n = scan(block.texts, phrases) if phrases else np.zeros(0, np.int64)
                cols = [[lang] * (len(phrases) + 1), ["", *phrases], [0, *(p.count(" ") + 1 for p in phrases)], np.append(np.count_nonzero(block.ids), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "size", "n"])

    each = rows.mapInArrow(count, "lang string, phrase string, size int, n long")
    return each.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, spread: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first ``top`` phrases.

    A phrase inside a longer one that occurs ``share`` hundredths as often is
    left out. The best of a lang are chosen in ``spread`` parts first.
    """
    counts = stored(phrase_counts(docs, least), "phrases")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    cuts = found.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    sized = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = sized.withColumn("score", F.expr(SCORE))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = found.where("size > 2").select("lang", "w", "a", F.col("size").alias("m"))
    inner = longer.select("lang", "w", "a", "m", F.explode(F.expr("sequence(2, m - 1)")).alias("s")).select("lang", "w", "a", "s", F.explode(F.expr("sequence(1, m - s + 1)")).alias("i"))
    around = inner.select("lang", part(F.col("i"), F.col("s")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")))

    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", (F.xxhash64("phrase") % spread).alias("part"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    all_ = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return all_.join(counts.where("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
