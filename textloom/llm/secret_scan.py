"""Secret scan: fixed patterns, and a battery of randomness tests on other long tokens.

The patterns give the base spans, which always stay. Every other run of 20 or
more characters of a text encoding is tested as follows. An equals sign ends a run.
What base spans leave of a run is tested by itself; where it was cut so, or no
single encoding holds it, it's also split at +/, at -_ and at both, every part of
20 or more characters is tested, and of overlapping discoveries the one of most
evidence stays.

* Its encoding is inferred: the smallest alphabet that holds its characters.
* Three tests ask whether it could be uniform over that alphabet: chi-squared
  (with the exact mean and variance of short strings, and against both tails, so
  that sequences such as the alphabet itself fail too), runs above and below the
  middle symbol, and lag-one serial correlation. Their combined p-value must
  not reject randomness.
* Its evidence against being written text is the likelihood ratio of the
  uniform model to a model of written identifiers (letter frequencies, sticky
  character classes). Such a ratio has mean one at most for written text, so it
  is an e-value, and the e-BH rule (Wang and Ramdas, 2022) over the candidates
  of one length band of one text keeps the expected share of false discoveries
  under ``rate``. Longer strings gather more evidence; short ones need more.

Digits alone are never added by the method, since account and phone numbers
are as uniform as keys.

Defined results: a null text is an empty one without spans; null doc_ids stay
null; repeated rows are scanned once each; an empty table gives no rows; other
columns, whatever their names, are ignored. Places are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

from pyspark.sql import DataFrame

from .frames import documents_of, map_batches, sliced

#: Fixed patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST = 20
#: What splits a run that no single encoding holds: the signs of base64, of base64url, and both.
SPLITS = tuple(re.compile(rf"[^{signs}]{{{LEAST},}}") for signs in ("+/", "_-", "+/_-"))
_KEYWORDS = ("passw", "secret", "token", "api")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of encodings, smallest first.
ALPHABETS = tuple(
    (name, {c: i for i, c in enumerate(symbols)})
    for name, symbols in (
        ("hex", _DIGITS + "abcdef"),
        ("HEX", _DIGITS + "ABCDEF"),
        ("base32", _UPPER + "234567"),
        ("lower36", _DIGITS + _LOWER),
        ("upper36", _DIGITS + _UPPER),
        ("base62", _UPPER + _LOWER + _DIGITS),
        ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
        ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    )
)
#: Relative frequencies of a to z in written text, in per mille.
LETTERS = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)))
#: Chance that the next character of written text is of the same class (lower, upper, digit, other).
STAY = 0.88
BANDS = (32, 64, 1 << 62)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns; failing matches are used up, as in a plain search."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def encoding(s: str) -> tuple[str, dict[str, int]] | None:
    held = set(s)
    return next(((n, a) for n, a in ALPHABETS if held <= a.keys()), None)


def rests(start: int, end: int, spans: list[tuple[int, str, int]], first: int) -> list[tuple[int, int]]:
    """What spans, sorted by start and looked at from the first on, leave of start to end."""
    found = []
    for k in range(first, len(spans)):
        a, _, b = spans[k]
        if a >= end:
            break
        if b > start:
            found.append((start, a))
            start = b
    return [(a, b) for a, b in [*found, (start, end)] if b - a >= LEAST]


def parts_of(text: str, start: int, end: int, cut: bool) -> list[tuple[int, int]]:
    """The places to be tested of a run: the run itself, or, where it was cut or no single encoding holds it, its parts too."""
    whole = encoding(text[start:end]) is not None
    if whole and not cut:
        return [(start, end)]
    found = {(m.start(), m.end()) for split in SPLITS for m in split.finditer(text, start, end)}
    return sorted(found | {(start, end)} if whole else found)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(s: str, alphabet: dict[str, int]) -> float:
    """Combined p-value of the three tests that s is uniform over the alphabet."""
    n, k = len(s), len(alphabet)
    at = [alphabet[c] for c in s]
    counts = [0] * k
    for i in at:
        counts[i] += 1
    chi = sum(c * c for c in counts) * k / n - n
    # A gamma of the statistic's exact mean and variance, made normal by its cube root (Wilson and Hilferty).
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    df = 2 * mean * mean / var
    z = (max(chi, 0.0) / mean) ** (1 / 3) - (1 - 2 / (9 * df))
    chi_p = _two_sided(z / math.sqrt(2 / (9 * df)))
    high = [i >= k // 2 for i in at]
    ups = sum(high)
    downs = n - ups
    if not ups or not downs:
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    expected = 1 + 2 * ups * downs / n
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs_p = _two_sided((runs - expected) / math.sqrt(max(spread, 1e-9)))
    middle = sum(at) / n
    square = sum((i - middle) ** 2 for i in at)
    lag = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / square if square else 1.0
    serial_p = _two_sided((lag + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (chi_p, runs_p, serial_p))  # Fisher: twice this is chi-squared, 6 degrees
    return math.exp(-half) * (1 + half + half * half / 2)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def evidence(s: str, alphabet: dict[str, int]) -> float:
    """Logarithm of the likelihood of s under the uniform model over that under written identifiers."""
    total, last = -len(s) * math.log(len(alphabet)), None
    letters = sum(LETTERS.values())
    for c in s:
        kind = _class(c)
        chance = 0.25 if last is None else STAY if kind == last else (1 - STAY) / 3
        chance *= LETTERS[c.lower()] / letters if kind < 2 else 0.1 if kind == 2 else 0.25
        total -= math.log(chance)
        last = kind
    return total


def discoveries(found: list[tuple[int, float]], rate: float) -> set[int]:
    """Indices kept by e-BH among (length, log e-value), each length band a family of its own."""
    kept: set[int] = set()
    for low, high in zip((0, *BANDS), BANDS):
        family = sorted(((e, i) for i, (n, e) in enumerate(found) if low <= n < high), reverse=True)
        m = len(family)
        best = max((j for j, (e, _) in enumerate(family, 1) if e >= math.log(m / (rate * j))), default=0)
        kept.update(i for _, i in family[:best])
    return kept


def spans_of(text: str, rate: float = 0.001, reject: float = 0.001) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    base = sorted(base_spans(text), key=order)
    tested, at = [], 0
    long = [w for w in text.split() if len(w) >= 20]
    for m in CANDIDATE.finditer(text) if long else ():
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        whole = at == len(base) or base[at][0] >= m.end()
        for low, high in [m.span()] if whole else rests(*m.span(), base, at):
            for start, end in parts_of(text, low, high, (low, high) != m.span()):
                s = text[start:end]
                if not s.isdigit() and (known := encoding(s)) and randomness(s, known[1]) >= reject:
                    tested.append((start, end, evidence(s, known[1])))
    random: list[tuple[int, str, int]] = []
    ends: list[int] = []
    for i in sorted(discoveries([(b - a, e) for a, b, e in tested], rate), key=lambda i: (-tested[i][2], i)):
        a, b, _ = tested[i]
        at = bisect.bisect_right(ends, a)  # the first chosen span that ends after a
        if at == len(ends) or random[at][0] >= b:
            random.insert(at, (a, "random", b))
            ends.insert(at, b)
    return base, sorted([*base, *random], key=order)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, rate: float = 0.001) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""

    def run(cols: dict) -> dict:
        found = [spans_of(t, rate) for t in cols["text"]]
        out = {"doc_id": cols["doc_id"]}
        for kind in KINDS[:3]:
            out[f"n_{kind}"] = [sum(s[1] == kind for s in base) for base, _ in found]
        out["base_sha256"] = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
        out["spans"] = [_joined(spans) for _, spans in found]
        return out

    return map_batches(documents_of(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, rate: float = 0.001, mark: str = "[secret]") -> str:
    """The text with every secret replaced by the mark; of an assignment, its value alone."""
    parts = []
    for a, kind, b in spans_of(text, rate)[1]:
        parts.append((ASSIGN.match(text, a).start(2) if kind == "assign" else a, b))
    out, at = [], 0
    for a, b in sorted(parts):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rate: float = 0.001) -> DataFrame:
    """The table with secrets in text replaced; n_chars, where there is one, is counted anew.

    Other columns, whatever their names, null texts and null ids stay as they
    are; every row comes back, repeated ones each; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    names = docs.columns
    places = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = f"_{names.index('text')}"
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(places.schema)

    def run(batches):
        for batch in sliced(batches):
            i = batch.schema.get_field_index(at)
            texts = [t if t is None else redact_text(t, rate) for t in batch.column(i).to_pylist()]
            columns = [c.cast(arrow.field(j).type) for j, c in enumerate(batch.columns)]
            columns[i] = pa.array(texts, type=arrow.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = places.mapInArrow(run, places.schema)
    if "n_chars" in names:
        n = f"_{names.index('n_chars')}"
        out = out.withColumn(n, F.length(at).cast(places.schema[n].dataType))
    return out.toDF(*names)
