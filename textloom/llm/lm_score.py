"""Texts scored by a hidden Markov language model that the corpus trains.

Words are counted over all training texts. The model emits symbols: the most
frequent words are one symbol each, others share symbols by their hash, and
seldom words share one: those seen at most twice, or past the ``lookup`` most
frequent ones, or never. A word is then one draw from its symbol's words, by
their counts, so the chance of a text is the chance of its symbols times that of
each word in its symbol. Words never seen are one class, as in the base score;
it is drawn as often as words were seen once (Good and Turing).

Latent states are trained by Baum-Welch: each task adds up expected counts over
its texts, the counts are combined by symbol, and the model, whose size doesn't
depend on the corpus, is fitted anew and broadcast. The scaled forward recursion
gives the exact likelihood of a text's symbols.

Only the counts of frequent words are broadcast, ``lookup`` at most; what seldom
words add to a text's sums comes from a join of (text, word) with all counts.

Defined results: a null or empty text is its end alone; a null doc_id is a
training row; repeated rows come back, and are learnt from, once each; without
training rows every word is unknown; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hidden_markov
from .frames import documents_of, sliced, stored

END = b"\n"  # no word holds white space
RARE, CLOSE, FIRST = 0, 1, 2  # the symbols of seldom words and of the end, and the first of a word of its own
#: Words whose count is at most this are seldom in any case.
SELDOM = 2
#: Texts are read in blocks of so many characters.
BLOCK = 8 << 20


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces split


class Lookup:
    """Counts of a bounded set of words, found by two hashes of 64 bits, the first of which is unique among them."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.seed = 1
        while len(np.unique(first := self._hashes(words, self.seed))) < len(words):
            self.seed += 1
        order = np.argsort(first)
        self.first, self.second, self.counts = first[order], self._hashes(words, 0)[order], counts[order]

    @staticmethod
    def _hashes(words: list[bytes], seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The count of each word, 0 where it isn't held."""
        if not len(self.first):
            return np.zeros(len(words), np.int64)
        first = self._hashes(words, self.seed)
        order = np.argsort(first)  # searched in order, places are near each other
        at = np.empty(len(words), np.int64)
        at[order] = np.minimum(np.searchsorted(self.first, first[order]), len(self.first) - 1)
        held = np.flatnonzero(self.first[at] == first)
        held = held[self.second[at[held]] == self._hashes([words[i] for i in held], 0)]
        out = np.zeros(len(words), np.int64)
        out[held] = self.counts[at[held]]
        return out


@dataclass
class Vocabulary:
    tokens: int  # N
    distinct: int  # V
    lookup: Lookup  # words of ``level`` and above
    level: int
    own: dict[bytes, int]  # symbols of the most frequent words
    shared: int  # symbols that other words share, a power of two
    symbol_counts: np.ndarray
    draws: list[float]  # chances of a draw from the rare symbol: the unknown class, a word seen once, twice, and each occurrence of others

    def unigram(self) -> np.ndarray:
        return (self.symbol_counts + 1e-3) / (self.symbol_counts + 1e-3).sum()

    def tables(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its count, symbol, base score, and log10 chance within its symbol; all words out of the lookup are taken as unknown."""
        n = self.lookup.find(words)
        symbol = np.full(len(words), RARE, np.uint16)
        for i in np.flatnonzero(n):
            symbol[i] = self.own.get(words[i]) or 1 + len(self.own) + (xxhash.xxh64_intdigest(words[i], 42) & (self.shared - 1))
        inside = np.log10(np.where(n > 0, n / np.maximum(self.symbol_counts[symbol], 1), self.draws[0]))
        return n, symbol, np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))), inside


def _rows(docs: DataFrame) -> DataFrame:
    return documents_of(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))


def _level() -> Column:
    """Frequencies in eighths of a power of two: a few hundred levels for any counts."""
    return F.floor(F.log2("n") * 8).cast("int")


def word_counts(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """(word, n) over training texts, the end included; a task combines up to ``most`` words before it sends them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                held[END] += 1
            if len(held) > most:
                yield send()
                held.clear()
        yield send()

    return rows.where("NOT held_out").select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, own: int = 12_288, shared: int = 4_096, lookup: int = 1_000_000) -> Vocabulary:
    """From (word, n): sums over all words, and the counts of at most ``lookup`` frequent ones."""
    ones = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3)]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), *ones).first()
    often = counts.where((F.col("n") > SELDOM) & (F.col("word") != END))
    levels = {r["level"]: r["words"] for r in often.groupBy(_level().alias("level")).agg(F.count("*").alias("words")).collect()}
    level, held = max(levels, default=0) + 1, 0
    for at in sorted(levels, reverse=True):
        held += levels[at]
        if held > lookup:
            break
        level = at
    often = often.where(_level() >= level)
    found = often.toArrow()  # at most ``lookup`` rows
    words, n = found["word"].to_pylist(), found["n"].to_numpy()
    top = sorted(zip((-n).tolist(), words))[:own]
    symbols = {END: CLOSE} | {w: FIRST + i for i, (_, w) in enumerate(top)}

    sums = np.zeros(1 + len(symbols) + shared)
    end = counts.where(F.col("word") == F.lit(END)).first()
    sums[CLOSE] = end["n"] if end else 0
    for word, times in zip(words, n.tolist()):
        sums[symbols.get(word) or 1 + len(symbols) + (xxhash.xxh64_intdigest(word, 42) & (shared - 1))] += times
    sums[RARE] = total["tokens"] - sums.sum()
    n1, n2, n3 = total["n1"], total["n2"], total["n3"]
    once, twice = (2 * n2 + 0.5) / n1 if n1 else 0.0, (3 * n3 + 0.5) / n2 if n2 else 0.0
    weight = n1 + 0.5 + n1 * once + n2 * twice + sums[RARE] - n1 - 2 * n2
    draws = [(n1 + 0.5) / weight, once / weight, twice / weight, 1 / weight]
    return Vocabulary(total["tokens"], total["distinct"], Lookup([END, *words], np.append(sums[CLOSE], n).astype(np.int64)) if end else Lookup([], n), level, symbols, shared, sums, draws)


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row a text, stored: row (a number), doc_id, held_out, n_tokens, n_known, base_score, inside: log10 chance of the words within their symbols, seldom: (word, times) of those out of the lookup, taken as unknown here, and symbols."""
    shipped = rows.sparkSession.sparkContext.broadcast(vocab)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "seldom", "symbols"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64()), pa.binary()]

    def block(ids: list, outs: list, texts: list[np.ndarray], numbers: dict) -> pa.RecordBatch:
        words = list(numbers)
        n, symbol, base, inside = shipped.value.tables(words)
        each = np.concatenate(texts)
        ends = np.cumsum(list(map(len, texts)))
        starts = np.append(0, ends[:-1])
        total = lambda values: np.add.reduceat(values, starts)
        out = n == 0
        out[0] = False  # the end, which only a table without training texts lacks
        seldom = [list(Counter([words[w] for w in t[out[t]]]).items()) for t in texts]
        cols = [ids, outs, ends - starts, total((n > 0)[each].astype(np.int64)), total(base[each]), total(inside[each]), seldom, [symbol[t].tobytes() for t in texts]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, outs, texts, numbers, size = [], [], [], _Numbers({END: 0}), 0
        for batch in sliced(batches, 128):
            for i, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                words = words_of(text)
                words.append(END)
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                outs.append(out)
                size += len(text)
            if size >= BLOCK:
                yield block(ids, outs, texts, numbers)
                ids, outs, texts, numbers, size = [], [], [], _Numbers({END: 0}), 0
        if ids:
            yield block(ids, outs, texts, numbers)

    spec = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, seldom map<binary, long>, symbols binary"
    return stored(rows.select("doc_id", "held_out", "text").mapInArrow(run, spec).withColumn("row", F.monotonically_increasing_id()), "encoded")


def seldom_known(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, known, base, inside): what a text's seldom training words add to the sums that took them as unknown."""
    asked = encoded.select("row", F.explode("seldom").alias("word", "times"))
    draws = [F.lit(d) for d in vocab.draws]
    draw = F.when(F.col("n") == 1, draws[1]).when(F.col("n") == 2, draws[2]).otherwise(draws[3] * F.col("n"))
    met = asked.join(counts.where((F.col("n") <= SELDOM) | (_level() < vocab.level)), "word")
    return met.groupBy("row").agg(
        F.sum("times").alias("known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / 0.5)).alias("base"),
        F.sum(F.col("times") * F.log10(draw / draws[0])).alias("inside"),
    )


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (np.frombuffer(s, np.uint16) for batch in sliced(batches) for s in batch.column("symbols").to_pylist())


def train(encoded: DataFrame, vocab: Vocabulary, states: int = 16, passes: int = 5) -> hidden_markov.Model:
    """Baum-Welch over all training texts, ``passes`` times; rows of counts are symbols, or below 0 the first states and the moves."""
    unigram = vocab.unigram()
    model = hidden_markov.start(unigram, states, stay=0.98)
    texts, sc = encoded.where("NOT held_out").select("symbols"), encoded.sparkSession.sparkContext
    names = [f"c{k}" for k in range(states)]
    for _ in range(passes):
        shipped = sc.broadcast(model.cast(np.float32))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = hidden_markov.Counts(len(unigram), states)
            for group in hidden_markov.blocks(_sequences(batches)):
                found.add(shipped.value, group)
            met = np.flatnonzero(found.emits.any(0))
            rows = np.concatenate([found.first[None], found.moves, found.emits.T[met]])
            at = np.concatenate([-1 - np.arange(states + 1), met]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, np.ascontiguousarray(rows.T))], ["symbol", *names])

        each = texts.mapInArrow(expect, "symbol int, " + ", ".join(f"{n} double" for n in names))
        summed = each.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a row a symbol
        at, values = summed["symbol"].to_numpy(), np.stack([summed[n].to_numpy() for n in names], 1)
        counts = hidden_markov.Counts(len(unigram), states)
        counts.emits[:, at[at >= 0]] = values[at >= 0].T
        if (at == -1).any():
            counts.first += values[at == -1][0]
        counts.moves[-2 - at[at < -1]] = values[at < -1]
        model = hidden_markov.step(counts, unigram)
        shipped.unpersist()
    return model


def likelihoods(encoded: DataFrame, model: hidden_markov.Model) -> DataFrame:
    """(row, log10 likelihood of the symbols)."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = (zip(*(c.to_pylist() for c in batch.columns)) for batch in sliced(batches))
        for group in hidden_markov.blocks(chain.from_iterable(lists), group=1 << 18, size=lambda r: len(r[1]) // 2):
            logs = hidden_markov.log_likelihoods(shipped.value, [np.frombuffer(r[1], np.uint16) for r in group]) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in group], pa.int64()), pa.array(logs)], ["row", "said"])

    return encoded.select("row", "symbols").mapInArrow(run, "row long, said double")


def score(docs: DataFrame, states: int = 16, passes: int = 5, own: int = 12_288, shared: int = 4_096, lookup: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    rows = _rows(docs)
    counts = stored(word_counts(rows), "words")
    vocab = vocabulary(counts, own, shared, lookup)
    encoded = encode(rows, vocab)
    said = likelihoods(encoded, train(encoded, vocab, states, passes))
    slim = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", F.col("inside").alias("words")).join(said, "row")
    found = slim.join(seldom_known(encoded, counts, vocab), "row", "left").fillna(0, ["known", "base", "inside"])
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("base")).alias("base_score"),
        (F.col("said") + F.col("words") + F.col("inside")).alias("score"),
    )
