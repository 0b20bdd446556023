"""Exact substring dedup by fingerprints of a sample of suffixes, in place of distributed prefix doubling.

Prefix doubling sorts a (position, rank) pair of every byte at each offset; this
takes many times the corpus' size in shuffled rows, beyond the disk that a job
is given (the figures are in the README; ``prefix_doubling`` has that form, for
small tables and to compare with). So here ranks are names given by hashing, for
a content-chosen sample of positions (a string synchronizing set, Kempa and
Kociumaka, 2019): in every ``span`` bytes, the position whose 16-byte gram hashes
least. Equal strings choose equal positions in all their occurrences, so every
repeated string of the threshold length holds a sampled position in the same
place of each of its occurrences, and nothing is missed.

Names are compared after Spark has brought equal ones together, at lengths that
grow until a position is unique or past the threshold:

1. Length 16, the gram. Names sent by one document alone are unique and go no
   further; only 32 bits of each distinct name are shuffled. Those that are left
   come back as a filter of bounded size; when it fills up at larger sizes it
   lets more positions through, and results stay the same.
2. All bytes within the threshold around the gram. If a smaller document has
   them, every string through the position is repeated: the whole surroundings
   are removed.
3. Otherwise, if other surroundings share the gram, each string of threshold
   length through the gram is ranked, and compared byte by byte.

Bytes are compared wherever they are at hand; the strings of grams of more than
``hot`` documents, and those alone, are told by names of 128 bits.

Only one position per rank and block of documents, in its smallest document,
is shuffled, the rest being settled on the spot. A gram of more than ``hot``
documents goes straight to step 3 and is grouped by its strings' names,
likewise one row per name and block; so no group grows with a common passage.

Defined results: a null text is an empty one; texts shorter than the threshold
keep all; a null doc_id is neither smaller nor larger than another, so such rows
keep all and cause no removal; rows that share a doc_id don't remove each
other's bytes, and come back once each; an empty table gives no rows; other
columns, whatever their names, are ignored. A text is read whole, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import documents_of

GRAM = 16
_U = np.uint64
_BASE, _BASE2, _MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
#: Bytes of text worked on at once, and positions gathered before they are settled.
_PIECE, _BLOCK = 1 << 20, 1 << 20
#: Surroundings hashed at once, few enough for a processor's cache.
_ROWS = 1 << 12


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(29))


def _hashes(data: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hashes of all runs of size bytes along the last axis, by doubling the length."""
    powers = {1: base}
    tables = {1: data.astype(np.uint64) + _U(1)}
    n = 1
    while 2 * n <= size:
        h = tables[n]
        tables[2 * n] = h[..., :-n] * powers[n] + h[..., n:]
        powers[2 * n] = _U(int(powers[n]) ** 2 & (1 << 64) - 1)
        n *= 2
    out, length = tables[n], n
    for m in sorted(tables, reverse=True):
        if m < n and size & m:
            rest = tables[m][..., length:]
            out = out[..., : rest.shape[-1]] * powers[m] + rest
            length += m
    return out


def _sliding(pick: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: -(width - n)], x[width - n :]) if n < width else x


def sampled(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram names): in each threshold bytes, wherever the least name stands."""
    width = threshold - GRAM + 1
    places, names = [], []
    for low in range(0, max(1, len(data) - threshold + 1), _PIECE):
        part = data[max(0, low - threshold) : low + _PIECE + 2 * threshold]
        if len(part) < threshold:
            continue
        h = _mixed(_hashes(part, GRAM))
        least = _sliding(np.minimum, h, width)
        edge = np.zeros(width - 1, np.uint64)
        best = _sliding(np.maximum, np.concatenate([edge, least, edge]), width)
        at = np.flatnonzero(best == h)
        places.append(at + max(0, low - threshold))
        names.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(places) == 1:
        return places[0], names[0]
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(names)[first]


class _Layout:
    """How names are dealt to buckets, and the filters that come back."""

    def __init__(self, buckets: int, threshold: int):
        self.buckets, self.threshold = buckets, threshold
        self.reach = threshold - GRAM
        self.width = threshold + self.reach
        rng = np.random.default_rng(11)
        self.weights = rng.integers(1, 1 << 63, self.width, dtype=np.uint64) * _U(2) + _U(1)

    def bucket(self, names: np.ndarray) -> np.ndarray:
        return ((names >> _U(32)) % _U(self.buckets)).astype(np.int64)

    def deal(self, names: np.ndarray, kind: int, **columns: np.ndarray) -> pa.RecordBatch | None:
        """One row per bucket with its columns, packed."""
        if not len(names):
            return None
        of = self.bucket(names)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        ends = np.r_[cuts[1:], len(order)]
        packed = [[dealt[a:b].tobytes() for a, b in zip(cuts, ends)] for dealt in (c[order] for c in columns.values())]
        packed += [[b""] * len(cuts)] * (6 - len(packed))
        return pa.RecordBatch.from_arrays([pa.array(of[order][cuts], pa.int64()), pa.array([kind] * len(cuts), pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names=["bucket", "kind", *"abcdef"])


_DEALT = "bucket long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"


def _probe(filters: tuple, which: int, layout: _Layout, names: np.ndarray) -> np.ndarray:
    """Whether each name may be in the filter: 0, names of several documents; 1, names of very many."""
    starts, masks, bits = filters[which]
    of = layout.bucket(names)
    found = np.ones(len(names), dtype=bool)
    for turn in (0, 1):
        slot = _slots(names & _U(0xFFFFFFFF), turn) & masks[of]
        at = starts[of] + slot.astype(np.int64)
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found & (masks[of] > 0)


def _slots(low: np.ndarray, turn: int) -> np.ndarray:
    return _mixed(low * _BASE + _U(turn + 1))


def _filter_of(low: np.ndarray, most_bits: int) -> bytes:
    """A two-probe Bloom filter with ten bits a name, up to most_bits; nothing for no names."""
    if not len(low):
        return b""
    size = min(most_bits, 1 << max(6, (10 * len(low) - 1).bit_length()))
    bits = np.zeros(size, dtype=bool)
    for turn in (0, 1):
        bits[(_slots(low.astype(np.uint64), turn) & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], layout: _Layout) -> Iterator[tuple]:
    """Sampled positions of many documents at a time: (texts, ids, tags, document of each position, position, name)."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, tag, text in zip(*[c.to_pylist() for c in batch.columns]):
            if doc is None:
                continue
            data = text.encode()
            at, names = sampled(np.frombuffer(data, np.uint8), layout.threshold)
            if len(at):
                held.append((data, doc, tag, at, names))
                size += len(at)
            if size >= _BLOCK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    data, docs, tags, at, names = zip(*held)
    return data, np.array(docs, np.int64), np.array(tags, np.int64).astype(np.uint32), np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at), np.concatenate(names)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, for sorted keys."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _runs(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value at the start of each element's run."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1]


def _merged(doc: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Intervals of each document, joined where they touch."""
    if not len(doc):
        return doc, tag, low, high
    order = np.lexsort((low, tag, doc))
    doc, tag, low, high = doc[order], tag[order], low[order], high[order]
    own = _first(doc, tag)
    lift = np.cumsum(own).astype(np.int64) << 40  # documents apart, so one running maximum does
    end = np.maximum.accumulate(high + lift)
    new = np.r_[True, (low + lift)[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return doc[new], tag[new], low[new], (end - lift)[last]


def _settled(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, around: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, key2, doc), and, in it, whether a smaller document has the same keys and, where they are given, bytes."""
    order = np.lexsort((doc, key2, key))
    new = _first(key[order], key2[order])
    beaten = doc[order] > _runs(new, doc[order])
    if around is not None:
        at = np.flatnonzero(beaten)
        least = _runs(new, order)
        for low in range(0, len(at), _ROWS):
            some = at[low : low + _ROWS]
            beaten[some] = (around[order[some]] == around[least[some]]).all(axis=1)
    return order, beaten


def _surroundings(data: bytes, at: np.ndarray, layout: _Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes around each position, how many of them before it, how many from it on)."""
    edge = np.zeros(layout.reach, np.uint8)
    padded = np.concatenate([edge, np.frombuffer(data, np.uint8), edge])
    return sliding_window_view(padded, layout.width)[at], np.minimum(at, layout.reach), np.minimum(len(data) - at, layout.threshold)


def _ranked(layout: _Layout, around: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Names of the surroundings."""
    rank = np.concatenate([around[i : i + _ROWS].astype(np.uint64) @ layout.weights for i in range(0, len(around), _ROWS)] or [np.zeros(0, np.uint64)])
    return _mixed(rank ^ (before * 256 + after).astype(np.uint64) * _BASE2)


def _strings(layout: _Layout, around: np.ndarray, before: np.ndarray, after: np.ndarray, name: np.ndarray) -> tuple:
    """(row, offset, key, key2) of every string of threshold length through each position."""
    offset = np.arange(layout.reach + 1)
    inside = (offset >= (layout.reach - before)[:, None]) & (offset + layout.threshold <= (layout.reach + after)[:, None])
    row, off = np.nonzero(inside)
    told = _mixed(name[row] + off.astype(np.uint64) * _BASE2)
    return row, off, _mixed(_hashes(around, layout.threshold)[row, off] ^ told), told


def _coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 128, then in steps of an eighth of a power of two, rounded up."""
    return np.where(n < 128, n, 128 + np.ceil(8 * np.log2(np.maximum(n, 128) / 128))).astype(np.uint8)


def _decoded(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.int64)
    return np.where(code < 128, code, np.round(128 * 2.0 ** ((code - 128) / 8))).astype(np.int64)


def _rank_grams(layout: _Layout):
    def run(batches):
        for _, _, _, of, _, names in _blocks(batches, layout):
            order = np.argsort(names, kind="stable")
            names, of = names[order], of[order]
            new = _first(names)
            docs = np.add.reduceat(_first(names, of).astype(np.int64), np.flatnonzero(new))
            names = names[new]
            out = layout.deal(names, 0, low=(names & _U(0xFFFFFFFF)).astype(np.uint32), docs=_coded(docs))
            if out is not None:
                yield out

    return run


def _gather(rows: pa.Table, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column].to_pylist()), dtype)


def _shared_grams(most_bits: int, hot: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        low, docs = _gather(rows, "a", np.uint32), _gather(rows, "b", np.uint8)
        order = np.argsort(low, kind="stable")
        low, docs = low[order], docs[order]
        start = np.flatnonzero(_first(low))
        total = np.add.reduceat(_decoded(docs), start)
        low = low[start]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "shared": pa.array([_filter_of(low[total > 1], most_bits)], pa.binary()), "hot": pa.array([_filter_of(low[total > hot], most_bits)], pa.binary())})

    return run


def _rank_surroundings(layout: _Layout, filters):
    def run(batches):
        known = filters.value
        for data, ids, tags, of, at, names in _blocks(batches, layout):
            keep = np.flatnonzero(_probe(known, 0, layout, names))
            of, at, names = of[keep], at[keep], names[keep]
            if not len(of):
                continue
            cuts = np.flatnonzero(_first(of))
            parts = [_surroundings(data[of[a]], at[a:b], layout) for a, b in zip(cuts, np.r_[cuts[1:], len(of)])]
            around, before, after = (np.concatenate(p) for p in zip(*parts))
            del parts
            doc, tag = ids[of], tags[of]
            # Of each rank, the rows in its smallest document here go on; the others are settled.
            rank = _ranked(layout, around, before, after)
            order, beaten = _settled(names, rank, doc, around)
            hit, left = order[beaten], order[~beaten]
            done = [(doc[hit], tag[hit], at[hit] - before[hit], at[hit] + after[hit])]
            hot = _probe(known, 1, layout, names[left])
            # Of common grams, their strings, one row per name in its smallest document here.
            some = left[hot]
            for low in range(0, len(some), _ROWS):
                pick = some[low : low + _ROWS]
                row, off, key, key2 = _strings(layout, around[pick], before[pick], after[pick], names[pick])
                row = pick[row]
                start = at[row] - layout.reach + off
                order, beaten = _settled(key, key2, doc[row])
                done.append((doc[row][order][beaten], tag[row][order][beaten], start[order][beaten], start[order][beaten] + layout.threshold))
                kept = order[~beaten]
                out = layout.deal(key[kept], 2, key=key[kept], key2=key2[kept], doc=doc[row][kept], tag=tag[row][kept], start=start[kept].astype(np.int64))
                if out is not None:
                    yield out
            left = left[~hot]
            shape = np.stack([before[left], after[left]], axis=1).astype(np.uint8)
            out = layout.deal(names[left], 0, name=names[left], doc=doc[left], tag=tag[left], at=at[left].astype(np.int64), shape=shape, around=around[left])
            if out is not None:
                yield out
            joined = _merged(*[np.concatenate(p).astype(t) for p, t in zip(zip(*done), (np.int64, np.uint32, np.int64, np.int64))])
            out = layout.deal(_mixed(joined[0].astype(np.uint64)), 1, doc=joined[0], tag=joined[1], low=joined[2], high=joined[3])
            if out is not None:
                yield out

    return run


def _compare(layout: _Layout, name, doc, tag, at, shape, around) -> list[tuple]:
    """Repeats among sampled positions of one bucket, sorted by name; whole groups of a name."""
    before, after = shape[:, 0].astype(np.int64), shape[:, 1].astype(np.int64)
    rank = _ranked(layout, around, before, after)
    order = np.lexsort((doc, rank, name))
    name, doc, tag, at, before, after, rank, around = (x[order] for x in (name, doc, tag, at, before, after, rank, around))
    new_rank, new_name = _first(name, rank), _first(name)
    beaten = doc > _runs(new_rank, doc)
    beaten[beaten] = (around[beaten] == around[_runs(new_rank, np.arange(len(doc)))[beaten]]).all(axis=1)
    done = [(doc[beaten], tag[beaten], (at - before)[beaten], (at + after)[beaten])]
    ranks = np.add.reduceat(new_rank.astype(np.int64), np.flatnonzero(new_name))[np.cumsum(new_name) - 1]
    # Of each rank, the rows in its smallest document; the first of them stands for the rank.
    rows = np.flatnonzero((ranks > 1) & ~beaten)
    first = np.flatnonzero(new_rank[rows])
    heads = rows[first]
    row, off, key, key2 = _strings(layout, around[heads], before[heads], after[heads], name[heads])
    order = np.lexsort((doc[heads][row], key2, key))
    new = _first(key[order], key2[order])
    least = _runs(new, order)
    smaller = doc[heads][row[order]] > doc[heads][row[least]]
    row, off, least = row[order][smaller], off[order][smaller], row[least][smaller]
    same = np.ones(len(row), dtype=bool)
    for k in range(layout.threshold):  # byte by byte, so a clash of names removes nothing
        same &= around[heads[row], off + k] == around[heads[least], off + k]
    row, off = row[same], off[same]
    # What holds for the head of a rank holds for its other rows in that document.
    members = np.diff(np.r_[first, len(rows)])
    copies = members[row]
    each = np.repeat(first[row], copies) + (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
    hit, off = rows[each], np.repeat(off, copies)
    start = at[hit] - layout.reach + off
    done.append((doc[hit], tag[hit], start, start + layout.threshold))
    return done


def _rank_strings(layout: _Layout, rows_at_once: int = _ROWS):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        own = lambda k: rows.filter(pa.array(kind == k))
        done = []
        part = own(1)
        done.append(tuple(_gather(part, c, t) for c, t in zip("abcd", (np.int64, np.uint32, np.int64, np.int64))))
        part = own(2)
        k, k2, doc, tag, start = (_gather(part, c, t) for c, t in zip("abcde", (np.uint64, np.uint64, np.int64, np.uint32, np.int64)))
        order, beaten = _settled(k, k2, doc)
        hit = order[beaten]
        done.append((doc[hit], tag[hit], start[hit], start[hit] + layout.threshold))
        part = own(0)
        name, doc, tag, at = (_gather(part, c, t) for c, t in zip("abcd", (np.uint64, np.int64, np.uint32, np.int64)))
        shape, around = _gather(part, "e", np.uint8).reshape(-1, 2), _gather(part, "f", np.uint8).reshape(-1, layout.width)
        order = np.argsort(name, kind="stable")
        new = np.flatnonzero(_first(name[order]))
        alone = np.diff(np.r_[new, len(order)]) == 1
        order = order[~np.repeat(alone, np.diff(np.r_[new, len(order)]))]
        starts = np.r_[np.flatnonzero(_first(name[order])), len(order)]
        low = 0
        while low < len(order):
            high = starts[max(np.searchsorted(starts, low + rows_at_once, side="right") - 1, np.searchsorted(starts, low, side="right"))]
            pick = order[low:high]
            done += _compare(layout, name[pick], doc[pick], tag[pick], at[pick], shape[pick], around[pick])
            low = high
        joined = _merged(*[np.concatenate(p).astype(t) for p, t in zip(zip(*done), (np.int64, np.uint32, np.int64, np.int64))])
        return pa.table({"doc": joined[0], "tag": joined[1].astype(np.int64), "span": joined[2] << 32 | joined[3]})

    return run


def removed_spans(docs: DataFrame, threshold: int = 50, hot: int = 32768, filter_bits: int = 1 << 29) -> DataFrame:
    """(doc, tag, span): removed intervals, start << 32 | end in bytes, some overlapping; tag is from the text."""
    spark = docs.sparkSession
    rows = documents_of(docs).select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), "text")
    buckets = max(16, 8 * rows.rdd.getNumPartitions())
    layout = _Layout(buckets, threshold)
    grams = rows.mapInArrow(_rank_grams(layout), _DEALT)
    segments = grams.groupBy("bucket").applyInArrow(_shared_grams(1 << max(6, (filter_bits // buckets).bit_length() - 1), hot), "bucket long, shared binary, hot binary").toArrow()
    filters = spark.sparkContext.broadcast(_assembled(segments, buckets))  # filter_bits / 4 bytes at most
    dealt = rows.mapInArrow(_rank_surroundings(layout, filters), _DEALT)
    return dealt.groupBy("bucket").applyInArrow(_rank_strings(layout), "doc long, tag long, span long")


def _assembled(segments: pa.Table, buckets: int) -> tuple:
    """The buckets' filters end to end: (start bit, size mask) of each, and the bits; a mask of zero is an empty one."""
    out = []
    for column in ("shared", "hot"):
        parts: list[bytes] = [b""] * buckets
        for b, x in zip(segments["bucket"].to_pylist(), segments[column].to_pylist()):
            parts[b] = x
        sizes = np.array([8 * len(p) for p in parts], dtype=np.int64)
        out.append((np.cumsum(sizes) - sizes, np.maximum(sizes - 1, 0).astype(np.uint64), np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)))
    return tuple(out)


def remove_repeats(docs: DataFrame, threshold: int = 50, hot: int = 32768, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also kept, the remaining bytes."""
    spans = removed_spans(docs, threshold, hot).groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))
    rows = documents_of(docs).withColumn("own", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    joined = rows.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("own") == F.col("tag")), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                parts, at, n = [], 0, 0
                for span in sorted(found or ()):
                    low, high = span >> 32, span & 0xFFFFFFFF
                    if low > at or not n:
                        parts.append(data[at:low])
                        n += 1
                    at = max(at, high)
                kept = b"".join([*parts, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(len(names))], names=names)

    return joined.mapInArrow(run, schema)
