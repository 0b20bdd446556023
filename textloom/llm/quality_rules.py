"""Quality rules by compression bands, beside counts of words, symbols, repeated lines and repeated word windows.

The verdict compresses each whole text, and each fixed chunk of it, with
zstandard. Repetitive text packs too well and random text hardly at all, so a
ratio outside the limits for the text's length rejects the document; chunks
find a bad passage in an otherwise normal long text.

Defined results: a null text has no words and, having under 50, fails the base
rules; an empty table gives no rows; repeated rows are judged once each; null
doc_ids stay null; other columns, whatever their names, are ignored; texts of
any length are compressed whole.
"""

from __future__ import annotations

import functools

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from .frames import documents_of, map_batches

#: (UTF-8 bytes below which it holds, least and greatest ratio of raw to packed size of the whole text). A very short text is mostly header.
BANDS = ((256, 0.0, 2.8), (1024, 1.1, 2.8), (4096, 1.3, 3.2), (16384, 1.4, 3.6), (1 << 62, 1.4, 4.6))
#: A whole chunk has limits of its own; the last, shorter one has those of a text of its length.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (1.2, 3.2), 0.25
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share double"


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window of that many words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    of = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    codes = of[:n].copy()
    for k in range(1, window):  # each step's codes are made dense, so they stay exact
        codes = codes * len(ids) + of[k : n + k]
        if k + 1 < window:
            codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


@functools.cache
def _packer() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


def limits(n_bytes: int) -> tuple[float, float]:
    """Least and greatest ratio of a text of so many bytes."""
    return next(b[1:] for b in BANDS if n_bytes < b[0])


def compression(data: bytes) -> tuple[float, float]:
    """Ratio of the whole, and the share of its bytes in chunks beyond their limits; the last chunk counts like any other."""
    if not data:
        return 0.0, 0.0
    packed = lambda x: len(x) / len(_packer().compress(x))
    whole = packed(data)
    if len(data) <= CHUNK_BYTES:
        return whole, 0.0
    bad = 0
    for i in range(0, len(data), CHUNK_BYTES):
        chunk = data[i : i + CHUNK_BYTES]
        low, high = CHUNK_BAND if len(chunk) == CHUNK_BYTES else limits(len(chunk))
        if not low <= packed(chunk) <= high:
            bad += len(chunk)
    return whole, bad / len(data)


def in_bands(n_bytes: int, ratio: float, chunk_share: float) -> bool:
    low, high = limits(n_bytes)
    return low <= ratio <= high and chunk_share <= CHUNK_SHARE


def judge(text: str) -> tuple:
    data = text.encode()
    words = data.split()  # bytes split at just the six ASCII white space characters
    n_repeat = repeated_words(words)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    ratio, share = compression(data)
    spaces = sum(map(text.count, SPACES))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), repeated_lines(text), n_repeat, failed, not failed and in_bands(len(data), ratio, share), ratio, share


def quality(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, the base verdict, and kept."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(cols: dict) -> dict:
        rows = [judge(t) for t in cols["text"]]
        return dict(zip(names, [cols["doc_id"], *(zip(*rows) if rows else [[]] * 9)]))

    return map_batches(documents_of(docs), run, SCHEMA)
