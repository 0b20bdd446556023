"""A hidden Markov model over sequences of symbols, in numpy: what one task adds up, and the step between passes.

Sequences of a block are laid out by time: all first symbols, then all second
ones of the sequences that have one, and so on, longest sequences first. Each
step of a recursion is then one product for all sequences at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Model:
    first: np.ndarray  # (states)
    moves: np.ndarray  # (states, states): from, to
    emits: np.ndarray  # (symbols, states): the chance of a symbol in a state

    def cast(self, kind: type) -> Model:
        return Model(*(np.ascontiguousarray(a, kind) for a in (self.first, self.moves, self.emits)))


def start(unigram: np.ndarray, states: int, stay: float = 0.9, seed: int = 11) -> Model:
    """States that differ from the symbols' overall chances by random factors, and are seldom left."""
    rng = np.random.default_rng(seed)
    emits = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
    moves = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(moves, stay if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(0))


class Layout:
    """Sequences laid out by time. order: their places in the given list, longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")  # with a symbol at each time
        self.starts = np.concatenate([[0], np.cumsum(self.active)])
        self.time = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.symbols = np.empty(len(self.time), np.int64)
        self.symbols[self.starts[self.time] + self.row] = np.concatenate([sequences[i] for i in self.order])


def forward(model: Model, at: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, e, c) by time: scaled forward chances of the states, chances of the symbols, and the scales."""
    e = model.emits[at.symbols]
    a, c, ones = np.empty_like(e), np.empty(len(e), e.dtype), np.ones(e.shape[1], e.dtype)
    before = None
    for low, n in zip(at.starts.tolist(), at.active.tolist()):
        x = a[low : low + n]
        np.multiply(model.first if before is None else before[:n] @ model.moves, e[low : low + n], out=x)
        s = np.dot(x, ones, out=c[low : low + n])
        x /= s[:, None]
        before = x
    return a, e, c


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms, one a sequence, each of one symbol at least."""
    at = Layout(sequences)
    logs = np.log(forward(model, at)[2])[at.starts[at.time] + at.row]
    out = np.empty(len(sequences))
    out[at.order] = np.bincount(at.row, logs, len(sequences))
    return out


class Counts:
    """Expected counts of a Baum-Welch pass, added up over blocks."""

    def __init__(self, symbols: int, states: int):
        self.first, self.moves, self.emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))

    def add(self, model: Model, sequences: list[np.ndarray]) -> None:
        at = Layout(sequences)
        a, e, c = forward(model, at)
        b = np.ones_like(a)
        e /= c[:, None]
        back = np.ascontiguousarray(model.moves.T)
        for low, n, high, m in list(zip(at.starts.tolist(), at.active.tolist(), at.starts[1:].tolist(), at.active[1:].tolist()))[::-1]:
            w = e[high : high + m]
            w *= b[high : high + m]  # from here on e holds what moves are weighted by
            np.dot(w, back, out=b[low : low + m])
        earlier = np.arange(at.active[0], len(a)) - np.repeat(at.active[:-1], at.active[1:])
        for low in range(0, len(earlier), 1 << 16):
            part = earlier[low : low + (1 << 16)]
            later = low + at.active[0]
            self.moves += a[part].T @ e[later : later + len(part)] * model.moves
        b *= a
        self.first += b[: at.active[0]].sum(0)
        for k in range(len(self.first)):
            self.emits[k] += np.bincount(at.symbols, b[:, k], self.emits.shape[1])


def step(counts: Counts, unigram: np.ndarray, prior: float = 0.01) -> Model:
    """The model that fits the counts best, each state's symbols drawn towards the overall chances by ``prior`` of its weight."""
    emits = counts.emits + (prior * counts.emits.sum(1, keepdims=True) + 1) * unigram
    moves, first = counts.moves + 1, counts.first + 1
    return Model(first / first.sum(), moves / moves.sum(1, keepdims=True), (emits / emits.sum(1, keepdims=True)).T)


def blocks(sequences: Iterator, most: int = 1 << 22, group: int = 1 << 19, size=len) -> Iterator[list]:
    """Sequences gathered up to ``most`` symbols, sorted by length, and cut into groups of about ``group`` symbols."""
    held, total = [], 0
    for s in sequences:
        held.append(s)
        total += size(s)
        if total >= most:
            yield from _groups(held, group, size)
            held, total = [], 0
    yield from _groups(held, group, size)


def _groups(held: list, group: int, size) -> Iterator[list]:
    held.sort(key=size, reverse=True)
    at, total = 0, 0
    for i, s in enumerate(held):
        total += size(s)
        if total >= group:
            yield held[at : i + 1]
            at, total = i + 1, 0
    if at < len(held):
        yield held[at:]
