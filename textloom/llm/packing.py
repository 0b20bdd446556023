"""Packing: first-fit decreasing over a tournament tree of bin capacities, in random groups.

Every document becomes ids (the vocabulary's, then a separator id), cut at
multiples of the capacity; the pieces are dealt at random into groups of about
``group_pieces``, and each group fills its own bins. A group is bounded
whatever the input, so no task grows with the data, and nothing but piece
lengths is shuffled.

Defined results: a null text is an empty one and yields one piece holding the
separator; a null doc_id stays null; repeated rows are packed once each; equal
lengths are placed in order of doc_id, then start, then row; an empty table gives no rows;
other columns, whatever their names, are ignored. A text of any length is read
whole.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import documents_of, map_batches, stored
from .vocab import spelled, vocab_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Characters for which lower-casing, composing and splitting go character by character, alike in Python and in the library.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_OTHER = re.compile("[^\t\n\r -~¡-įı-ſ]")
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class WordIds(dict):
    """Little-endian ids of a run without white space, kept for runs seen before.

    The vocabulary never merges across white space, so ids of a text are those
    of its runs in order. Where ``most`` runs are kept, all are forgotten and
    frequent ones soon back.
    """

    def __init__(self, name: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab_path(name))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()))
        self.model, self.parts, self.most = self.library.model, {}, most

    def __missing__(self, run: str) -> bytes:
        found = b"".join([self.parts.get(p) or self.part(p) for p in _PART.findall(run.lower())])
        if len(self) >= self.most:
            self.clear()
        if len(run) < 64:
            self[run] = found
        return found

    def part(self, text: str) -> bytes:
        ids = np.array([t.id for t in self.model.tokenize(spelled(text.encode()))], dtype="<u4").tobytes()
        if len(self.parts) >= self.most:
            self.parts.clear()
        if len(text) < 64:
            self.parts[text] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The library's ids for the whole text, special strings handled as it does by default."""
        if _OTHER.search(text) or ("<|" in text and self.special.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def word_ids(name: str) -> WordIds:
    return WordIds(name)


def cut_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", capacity: int = 4096, separator: int = 2) -> DataFrame:
    """One row per piece: its place in the document's ids, its length and checksum."""
    end, step = int(separator).to_bytes(4, "little"), 4 * capacity

    def cut(cols: dict) -> dict:
        ids_of = word_ids(vocab).ids
        rows = []
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            ids = ids_of(text) + end
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows) if rows else [[]] * 5))

    return map_batches(documents_of(docs), cut, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, given in decreasing order.

    A tournament tree holds at each inner node the larger free space of its two
    children, so the first bin that fits is found by one walk from the root.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    alone = int(np.searchsorted(-np.asarray(lengths), -capacity, side="right"))
    bins[:alone] = np.arange(alone)
    leaves = 1 << max(0, (n - alone - 1).bit_length())
    free = [capacity] * (2 * leaves)
    for i, size in enumerate(lengths[alone:].tolist(), start=alone):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = alone + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node >>= 1
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", capacity: int = 4096, separator: int = 2, group_pieces: int = 8192) -> DataFrame:
    """Pieces with sequence_id and offset; see the module for the defined results.

    The pieces are written to the shared folder once, since their number decides
    that of the groups. Which group a row falls in follows from its place there.
    """
    pieces = stored(cut_documents(docs, vocab, capacity, separator), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        where, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows = rows.drop_columns(["group", "row"]).append_column("sequence_id", pa.array((key[0].as_py() << 24) + where))
        return rows.append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(fill, PIECES + ", sequence_id long, offset long")
