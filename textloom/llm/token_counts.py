"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

Within one pre-token, the encoding of a prefix is the encoding of a shorter
prefix and one last token, and that token is the only vocabulary entry that
ends there and can stand after the last token of the shorter prefix (two tokens
can be neighbours when merging their bytes together gives just these two). So
one pass over a pre-token stores the exact count of every prefix. These tables
are kept for pre-tokens seen before; a text's count is the sum of their last
entries, and laid end to end they are the text's own table: its exact count at
every prefix, by which truncation and budget questions are look-ups. Where a
cut changes how its last pre-token is parted (white space, contractions, special
strings), the table has the count of the parts that the cut leaves.

Defined results: a null text is an empty one with no tokens; a null doc_id
stays null; repeated rows are counted once each; an empty table gives no rows;
other columns, whatever their names, are ignored; texts of any length are read
whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import documents_of, map_batches
from .vocab import spelled, vocab_path

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"


def _pattern(letter: str, number: str, neither: str) -> str:
    """The vocabulary's pre-token pattern (a fixed value) with its character classes filled in."""
    return rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?{neither}+|\s+(?!\S)|\s+"


#: For texts of these characters alone the standard library's expressions agree with the Unicode classes.
_PLAIN = re.compile(_pattern(f"[{_LETTERS}]", f"[{_NUMBERS}]", rf"[^\s{_LETTERS}{_NUMBERS}]"))
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")
#: White space as the vocabulary has it; that of the standard library has four control characters more.
_RUNS = regex.compile(r"\s+")
#: Contractions that a cut before their end parts in two.
_CUT = frozenset(("'ll", "'ve", "'re"))
#: Tables of pre-tokens of fewer bytes are kept.
KEPT_BYTES = 64
#: A space beside other white space: elsewhere a space always begins a pre-token.
_GAP = re.compile(r" \s|\s ")


class PrefixCounts:
    """Exact token counts of every prefix, for one vocabulary file."""

    def __init__(self, name: str, most: int = 500_000):
        with open(vocab_path(name), encoding="utf-8") as f:
            file = json.load(f)
        alphabet = {c: b for b, c in enumerate(spelled(bytes(range(256))))}
        raw = lambda s: bytes([alphabet[c] for c in s])
        specials = [t["content"] for t in file["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.bytes_of = {i: raw(s) for s, i in file["model"]["vocab"].items() if s not in specials}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        #: The merge that makes each token: (rank, left, right).
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), i in self.rank.items():
            self.made.setdefault(a + b, (i, a, b))
        lengths: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 1:
                lengths.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of the tokens that end in two bytes, longest first.
        self.lengths = {end: (*sorted(found, reverse=True), 1) for end, found in lengths.items()}
        self.any = regex.compile(_pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
        self.most, self.whole, self.beside, self.tables, self.spaced = most, {}, {}, {}, {}

    def merged(self, data: bytes) -> list[bytes]:
        """The parts of data after all merges, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, token: bytes) -> bool:
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = len(self.merged(token)) == 1
        return found

    def follows(self, left: bytes, right: bytes) -> bool:
        found = self.beside.get((left, right))
        if found is None:
            found = self._beside(left, right)
            self._keep(self.beside, (left, right), found, 2 * self.most)
        return found

    def _beside(self, left: bytes, right: bytes) -> bool:
        """Whether merging left and right, each a single token, together gives just these two.

        Taking back the later of the two last merges leads to the neighbours at
        the border before it; a merge across the border that comes first would
        have been made.
        """
        rank, made, limit = self.rank, self.made, 1 << 40
        while True:
            if rank.get((left, right), 1 << 40) < limit:
                return False
            a, b = made.get(left), made.get(right)
            if a is not None and (b is None or a[0] > b[0]):
                limit, left = a[0], a[2]
            elif b is not None:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def _keep(self, kept: dict, key, value, most: int) -> None:
        """Where most are kept, all are forgotten and frequent ones soon back."""
        if len(kept) >= most:
            kept.clear()
        kept[key] = value

    def table(self, data: bytes) -> list[int]:
        """The token count of data[:i] at place i, for a single pre-token."""
        last, count, ids, beside, follows = [b""], [0], self.id_of, self.beside, self.follows
        only = (1,)
        for end in range(1, len(data) + 1):
            for n in self.lengths.get(data[end - 2 : end], only) if end > 1 else only:
                begin = end - n
                if begin < 0:
                    continue
                token = data[begin:end]
                if token in ids and ((beside.get((last[begin], token)) or follows(last[begin], token)) if begin else self.stands(token)):
                    last.append(token)
                    count.append(count[begin] + 1)
                    break
        return count

    def table_of(self, piece: str) -> Sequence[int]:
        """The table of a pre-token, kept where it is short."""
        found = self.tables.get(piece)
        if found is None:
            found = self.table(piece.encode())
            if len(found) <= KEPT_BYTES:
                found = bytes(found)
                self._keep(self.tables, piece, found, self.most)
        return found

    def pieces(self, text: str) -> list[str]:
        return (self.any if _OTHER.search(text) else _PLAIN).findall(text)

    def total(self, piece: str) -> int:
        return self.table_of(piece)[-1]

    def run(self, text: str) -> int:
        return sum([self.table_of(p)[-1] for p in self.pieces(text)])

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings, by the runs between its single spaces."""
        if _OTHER.search(text) or _GAP.search(text):
            return self.run(text)
        head, *rest = text.split(" ")
        spaced = self.spaced
        try:
            return self.run(head) + sum([spaced[r] for r in rest])
        except KeyError:
            found = self.run(head)
            for r in rest:
                n = spaced.get(r)
                if n is None:
                    n = self.run(" " + r)
                    if len(r) < KEPT_BYTES:
                        self._keep(spaced, r, n, self.most)
                found += n
            return found

    def count(self, text: str) -> int:
        """What the library counts by default: a special string is one token."""
        if "<|" not in text or not (specials := self.special.findall(text)):
            return self.plain(text)
        return len(specials) + sum(self.plain(t) for t in self.special.split(text))

    def prefixes(self, text: str) -> np.ndarray:
        """The exact token count of text[:i] at place i."""
        out = np.zeros(len(text) + 1, np.int32)
        at = before = 0
        for i, part in enumerate(self.special.split(text)):
            last = at
            if i:
                end = self.special.match(text, at).end()
                # The beginning of a special string is ordinary text, part of what stands before.
                base = before - self.total(text[back:at]) if at > back else before
                for cut in range(at + 1, end):
                    out[cut] = base + self.run(text[back:cut])
                before += 1
                out[end] = before
                at = last = end
            for piece in self.pieces(part):
                last = at
                at = self._fill(out, at, before, piece)
                before = int(out[at])
            self._spaces(out, text, at - len(part), at)
            back = last
        return out

    def _fill(self, out: np.ndarray, at: int, before: int, piece: str) -> int:
        """Write the counts of the prefixes that end in a piece; the place after it."""
        table = self.table_of(piece)
        end = at + len(piece)
        if len(table) == len(piece) + 1:  # a character is a byte
            out[at + 1 : end + 1] = np.frombuffer(table, np.uint8)[1:] if isinstance(table, bytes) else table[1:]
        else:
            ends = np.cumsum([len(c.encode()) for c in piece])
            out[at + 1 : end + 1] = np.array(list(table), np.int32)[ends]
        out[at + 1 : end + 1] += before
        if piece in _CUT:
            out[end - 1] = before + self.total(piece[:1]) + self.total(piece[1:2])
        return end

    def _spaces(self, out: np.ndarray, text: str, low: int, high: int) -> None:
        """White space before a cut is one piece, whatever follows it in the text."""
        for m in _RUNS.finditer(text, low, high):
            if m.end() - m.start() > 1:
                table = self.table_of(m[0])
                ends = np.cumsum([len(c.encode()) for c in m[0]])
                own = out[m.start()] + np.array(list(table), np.int32)[ends]
                out[m.start() + 1 : m.end() + 1] = own

    def count_at(self, known: np.ndarray, cut: int) -> int:
        """Tokens of the prefix of that many characters, from the text's table."""
        return int(known[max(0, min(cut, len(known) - 1))])

    def truncate(self, known: np.ndarray, budget: int) -> int:
        """The longest cut whose prefix has at most budget tokens, from the text's table."""
        within = np.flatnonzero(known <= budget)
        return int(within[-1]) if len(within) else 0


@functools.cache
def prefix_counts(name: str) -> PrefixCounts:
    return PrefixCounts(name)


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text."""

    def count(cols: dict) -> dict:
        counts = prefix_counts(vocab).count
        tokens = [counts(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in cols["text"]], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_batches(documents_of(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, counts: the exact token count at every prefix, at places 0 to the text's number of characters.

    prefix_count and longest_within answer questions about it without the text.
    """

    def tables(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "counts": [prefix_counts(vocab).prefixes(t) for t in cols["text"]]}

    return map_batches(documents_of(docs), tables, "doc_id long, counts array<int>", rows=32)


def prefix_count(counts: Column, cut: Column) -> Column:
    """The tokens of the prefix of so many characters; beyond the ends, of none or of the whole text."""
    return F.get(counts, F.greatest(F.lit(0), F.least(cut, F.size(counts) - 1)))


def longest_within(counts: Column, budget: Column) -> Column:
    """The most characters whose prefix has at most so many tokens."""
    fits = F.reverse(F.transform(counts, lambda n: n <= budget))
    return F.greatest(F.lit(0), F.size(counts) - F.array_position(fits, True).cast("int"))


def truncate_documents(docs: DataFrame, budget: int, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, text cut to its longest prefix within the budget, n_tokens of that."""

    def cut(cols: dict) -> dict:
        p, kept, counts = prefix_counts(vocab), [], []
        for t in cols["text"]:
            known = p.prefixes(t)
            at = p.truncate(known, budget)
            kept.append(t[:at])
            counts.append(p.count_at(known, at))
        return {"doc_id": cols["doc_id"], "text": kept, "n_tokens": counts}

    return map_batches(documents_of(docs), cut, "doc_id long, text string, n_tokens long")
