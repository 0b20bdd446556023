"""Toxicity by subword-bag embeddings averaged into a linear softmax (Joulin et al., 2016), trained jointly in numpy.

A word is the bag of its character n-grams of 3 to 5, with marks at both ends,
hashed into buckets; a text is the mean over its words of the mean of their
n-grams' vectors. A misspelt word shares most n-grams with the right one, and
each text is learnt from twice, once with slips in half of its longer words.
Embeddings and softmax are trained together by Adagrad. Since the model is
linear after averaging, each bucket then has one number, each word the mean of
its buckets', and scoring a text is one lookup per word.

Training takes at most ``per_class`` labelled rows of each class, the least by
hash of doc_id; their bags wait on the driver's disk, which that bound and
``buckets`` bound, and memory holds those of one step. The prior of the labelled
rows is put back afterwards. Every text is scored whole;
n-grams are worked out in blocks of many words, or of a part of a long one (a
text without white space is one), which bound their memory.

Defined results: null and wordless texts score as the model's bias alone;
labels that are null or not 0 or 1 are ignored, and of several labels of a document
the greatest counts; of several texts of a labelled document the least is
learnt from; without rows of both classes every score is the share of
label 1 (0 if there are no labels); repeated rows are scored once each, null
doc_ids (crc32 of no text: not held out) stay null; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import contextlib
import math
import random
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents_of, map_batches, pick, sliced

SHORTEST, LONGEST = 3, 5
#: Words are read in blocks of BLOCK bytes; a bag of more than MOST_GRAMS is summed up in between.
BLOCK, MOST_GRAMS = 1 << 16, 1 << 18
#: Texts are scored about so many characters at a time; words of KEPT_CHARS or more are worked out each time.
GROUP_CHARS, KEPT_CHARS = 1 << 20, 64
#: Bags are fetched about so many at a time.
FETCHED = 128
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_STRIP = ".,;:!?|()[]\"'"
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def grams(word: bytes, buckets: int) -> list[int]:
    """Buckets of the n-grams of a stripped word's bytes."""
    word = b"<%b>" % word
    crc, size = zlib.crc32, len(word)
    return [crc(word[i : i + n]) % buckets for n in range(SHORTEST, min(LONGEST, size) + 1) for i in range(size - n + 1)] or [crc(word) % buckets]


def word_grams(words: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place of the word) of all n-grams of stripped words, in arrays of at most BLOCK; a block's checksums advance together."""
    marked = [b"<%b>" % w for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(marked), np.uint8)
    for low in range(0, len(raw), BLOCK):
        part = raw[low : low + BLOCK + LONGEST - 1]
        at = np.arange(min(BLOCK, len(raw) - low))
        of = np.searchsorted(ends, at + low, side="right")
        room = ends[of] - low - at  # bytes left in the word
        state = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for n in range(LONGEST):
            inside = room[at] > n
            at, state = at[inside], state[inside]
            state = _CRC[(state ^ part[at + n]) & 0xFF] ^ (state >> 8)
            if n + 1 >= SHORTEST:
                yield ((state ^ 0xFFFFFFFF) % buckets).astype(np.int32), of[at]
    wordless = np.flatnonzero(sizes < SHORTEST)
    if len(wordless):
        yield np.full(len(wordless), zlib.crc32(b"<>") % buckets, np.int32), wordless


def gram_blocks(word: bytes, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of grams(), in arrays of at most BLOCK."""
    return (g for g, _ in word_grams([word], buckets))


def n_grams(size: int) -> int:
    """How many n-grams a word of so many bytes has, its marks not counted in."""
    return sum(max(size + 2 - n + 1, 0) for n in range(SHORTEST, LONGEST + 1)) or 1


def _groups(words: list[bytes], size: int) -> Iterator[slice]:
    """Neighbouring words of at most so many bytes together, or one longer word."""
    low = held = 0
    for i, w in enumerate(words):
        if held and held + len(w) > size:
            yield slice(low, i)
            low, held = i, 0
        held += len(w) + 2
    if low < len(words):
        yield slice(low, len(words))


def bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight): the mean over words of the mean over their n-grams; summed over all buckets where a text has very many."""
    counts = Counter(text.lower().split())
    n = counts.total()
    words = [w.strip(_STRIP).encode() for w in counts]
    share = np.array([c / (n * n_grams(len(w))) for c, w in zip(counts.values(), words)])
    at, weight, held = [], [], 0
    total = np.zeros(0)
    for own in _groups(words, BLOCK):
        for g, of in word_grams(words[own], buckets):
            at.append(g)
            weight.append(share[own][of])
            held += len(g)
            if held > MOST_GRAMS:
                total = np.bincount(np.concatenate(at), np.concatenate(weight), buckets) + (total if len(total) else 0)
                at, weight, held = [], [], 0
    if len(total):
        total += np.bincount(np.concatenate(at), np.concatenate(weight), buckets) if at else 0
        found = np.flatnonzero(total).astype(np.int32)
        return found, total[found].astype(np.float32)
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, where = np.unique(np.concatenate(at), return_inverse=True)
    return found, np.bincount(where, np.concatenate(weight)).astype(np.float32)


def misspelt(text: str, share: float = 0.5) -> str:
    """The text with about that share of its longer words written with one slip: a letter lost, doubled, swapped or wrong."""
    rng = random.Random(zlib.crc32(text.encode()))
    words = text.split()
    for k, w in enumerate(words):
        if len(w) > 3 and rng.random() < share:
            i = rng.randrange(1, len(w) - 1)
            words[k] = w[:i] + rng.choice((w[i + 1 :], w[i] + w[i:], w[i + 1] + w[i] + w[i + 2 :], rng.choice(_LETTERS) + w[i + 1 :]))
    return " ".join(words)


class Model(NamedTuple):
    """bias + mean over words of the mean of their buckets' numbers is the log odds of label 1."""

    numbers: np.ndarray
    bias: float


class Spool:
    """Bags on the driver's disk, of which memory holds those being read; closed, the file is gone."""

    def __init__(self):
        self._file = tempfile.TemporaryFile()
        self._places: list[tuple[int, int]] = []
        self._end = 0

    def append(self, packed: bytes) -> None:
        """A bag as its buckets' bytes and then its weights', four each."""
        self._places.append((self._end, len(packed)))
        self._end += self._file.write(packed)

    def __len__(self) -> int:
        return len(self._places)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        start, size = self._places[i]
        self._file.seek(start)
        raw = self._file.read(size)
        return np.frombuffer(raw, np.int32, size // 8), np.frombuffer(raw, np.float32, size // 8, size // 2)

    def arrange(self, order: Iterable[int]) -> None:
        self._places = [self._places[i] for i in order]

    def close(self) -> None:
        self._file.close()


def train(bags: Sequence[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, prior: float, buckets: int, dim: int = 8, epochs: int = 12, batch: int = 32, rate: float = 0.3, scale: float = 60.0, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adagrad on the softmax loss; averages over hundreds of words are small, so inputs are scaled up."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full_like(x, 1e-3) for x in (out, bias)]
    sum_v = np.full((buckets, dim), 1e-6, np.float32)
    share = toxic.mean()
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            read = [bags[r] for r in rows]
            at = np.concatenate([b[0] for b in read])
            weight = np.concatenate([b[1] for b in read]) * scale
            of = np.repeat(np.arange(len(rows)), [len(b[0]) for b in read])
            used, place = np.unique(at, return_inverse=True)
            own = vectors[used]
            mean = np.stack([np.bincount(of, weight * own[place, k], len(rows)) for k in range(dim)], axis=1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), toxic[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            grad = np.stack([np.bincount(place, weight * back[of, k], len(used)) for k in range(dim)], axis=1).astype(np.float32)
            for x, s, g in ((out, sums[0], mean.T @ p), (bias, sums[1], p.sum(axis=0))):
                s += g * g
                x -= rate / 5 * g / np.sqrt(s)
            sum_v[used] += grad * grad
            vectors[used] -= decay * own
            vectors[used] -= rate * grad / np.sqrt(sum_v[used])
    odds = lambda x: math.log(x / (1 - x))
    numbers = (vectors @ (out[:, 1] - out[:, 0]) * scale).astype(np.float32)
    return Model(numbers, float(bias[1] - bias[0]) + odds(prior) - odds(share))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, buckets: int = 1 << 17, train_on: Column | None = None) -> Model:
    """A model from at most per_class labelled rows of either class outside the held-out fold."""
    marked = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = documents_of(docs)
    known = marked.where(~held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(np.zeros(buckets, np.float32), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    least = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = least(0).union(least(1))  # 2 * per_class rows of two numbers: bounded, so they may be broadcast
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def bags(cols: dict) -> dict:
        found = [bag(x, buckets) for t in cols["text"] for x in (t, misspelt(t))]
        twice = lambda c: [x for x in cols[c] for _ in "ab"]
        return {"doc_id": twice("doc_id"), "toxic": twice("toxic"), "copy": [0, 1] * len(cols["text"]), "bag": [b.tobytes() + w.tobytes() for b, w in found]}

    found = map_batches(texts, bags, "doc_id long, toxic int, copy int, bag binary")
    rows_of = []
    with contextlib.closing(Spool()) as spool:
        # About FETCHED bags a partition: the driver has one partition at a time, not all bags.
        for r in found.repartition(math.ceil(4 * per_class / FETCHED), "doc_id", "copy").toLocalIterator():
            rows_of.append((r["doc_id"], r["copy"], r["toxic"]))
            spool.append(r["bag"])
        order = sorted(range(len(rows_of)), key=rows_of.__getitem__)
        toxic = np.array([rows_of[i][2] for i in order], dtype=np.int64)
        if len(set(toxic.tolist())) < 2:
            return Model(np.zeros(buckets, np.float32), math.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
        spool.arrange(order)
        return train(spool, toxic, prior, buckets)


class _Scorer(dict):
    """Each word's number, kept for words seen before; where ``most`` are kept, all are forgotten and frequent ones soon back."""

    def __init__(self, model: Model, most: int = 250_000):
        self.numbers, self.bias, self.most = model.numbers, model.bias, most

    def learn(self, runs: list[str]) -> None:
        """The numbers of new words, worked out together."""
        words = [r.strip(_STRIP).encode() for r in runs]
        for own in _groups(words, BLOCK):
            few = words[own]
            total = np.zeros(len(few))
            for g, of in word_grams(few, len(self.numbers)):
                total += np.bincount(of, self.numbers[g], len(few))
            self.update(zip(runs[own], (total / [n_grams(len(w)) for w in few]).tolist()))

    def __missing__(self, run: str) -> float:
        self.learn([run])
        return self[run]

    def forget(self) -> None:
        self.clear()

    def _scores(self, texts: list[list[str]]) -> list[float]:
        runs = set().union(*texts)
        new = [r for r in runs if r not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(runs)
        self.learn(new)
        odds = [self.bias + (sum(map(self.__getitem__, words)) / len(words) if words else 0.0) for words in texts]
        for run in new:
            if len(run) >= KEPT_CHARS:
                del self[run]
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in odds]

    def scores(self, texts: Iterable[str]) -> list[float]:
        """The scores of the texts, words looked up for about GROUP_CHARS at a time."""
        out, held, chars = [], [], 0
        for t in texts:
            held.append(t.lower().split())
            chars += len(t)
            if chars > GROUP_CHARS:
                out += self._scores(held)
                held, chars = [], 0
        return out + self._scores(held)

    def score(self, text: str) -> float:
        return self.scores([text])[0]


_scorers: dict[int, _Scorer] = {}


def _scorer(model: Model) -> _Scorer:
    """One scorer per model in each worker, the latest model's alone."""
    key = zlib.crc32(model.numbers.tobytes()) ^ hash(model.bias)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(model)
    return _scorers[key]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every whole text."""

    def run(cols: dict) -> dict:
        scorer = _scorer(model)
        scores = scorer.scores(cols["text"])
        return {"doc_id": cols["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_batches(documents_of(docs), run, "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that the model doesn't predict as toxic, all columns as they are."""
    places = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(model)
        for batch in sliced(batches):
            clean = [x < threshold for x in scorer.scores(t or "" for t in batch.column(at).to_pylist())]
            yield batch.filter(pa.array(clean, type=pa.bool_()))
        scorer.forget()  # workers live on: later stages need the memory

    return places.mapInArrow(run, places.schema).toDF(*docs.columns)
