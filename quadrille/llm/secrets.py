"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Runs of token characters that could be encoded key material are candidates.  The encoding is inferred from the
characters used (hexadecimal, base 32 and base 36 of either case, letters of both cases, base 62, base 64 of either
dialect); letters of one case only fit none.  Under the hypothesis that a candidate's symbols are independent and uniform over its alphabet, three tests give
p-values: chi-squared uniformity, Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial
correlation; three times the least of them is the candidate's p-value.  Within each class of lengths (powers of two)
the Benjamini-Hochberg procedure over all candidates of the corpus decides which are *not* random; the others are
reported.  Short runs have little power, hence the classes, and a floor on the bits that a run carries.

P-values are rounded up to a grid of 1/64 in the logarithm, so a class is a histogram of bounded size: Spark adds the
histograms up and the procedure is exact for the rounded values.

A null or empty text has no spans.  Rows are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, query, table

KINDS = ("assign", "access", "hex", "random")
#: Length of the shortest candidate, bits it must carry, and the false-discovery rate.
MIN_LENGTH, MIN_BITS, RATE = 20, 80.0, 0.05
GRID = 64

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order of their digits.
ALPHABETS = (
    ("hex", _DIGITS + "abcdef", ("digit", "lower")),
    ("HEX", _DIGITS + "ABCDEF", ("digit", "upper")),
    ("base32", _UPPER + "234567", ("digit", "upper")),
    ("base62", _UPPER + _LOWER + _DIGITS, ("digit", "lower", "upper")),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", ("digit", "lower", "upper")),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", ("digit", "lower", "upper")),
    ("base32lower", _LOWER + "234567", ("digit", "lower")),
    ("base36", _DIGITS + _LOWER, ("digit", "lower")),
    ("BASE36", _DIGITS + _UPPER, ("digit", "upper")),
    ("letters", _UPPER + _LOWER, ("lower", "upper")),
)
_NARROWEST = [(name, set(letters), classes) for name, letters, classes in sorted(ALPHABETS, key=lambda a: len(a[1]))]
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters, _ in ALPHABETS}
_CLASSES = {"digit": set(_DIGITS), "lower": set(_LOWER), "upper": set(_UPPER)}


def encoding(run: str) -> str | None:
    """The narrowest alphabet that holds the run and of which it uses every class of characters."""
    used = set(run)
    for name, letters, classes in _NARROWEST:
        if used <= letters and all(used & _CLASSES[c] for c in classes):
            return name
    return None


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, name: str) -> float:
    """p-value of uniform independence of the run's symbols: Bonferroni over the three tests."""
    values = [_PLACES[name][c] for c in run]
    n, k = len(values), len(_PLACES[name])
    counts: dict[int, int] = defaultdict(int)
    for v in values:
        counts[v] += 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    free = k - 1
    scale = 2 / (9 * free)
    uniform = _upper_tail(((max(chi, 0.0) / free) ** (1 / 3) - (1 - scale)) / math.sqrt(scale))
    high = [v * 2 >= k for v in values]
    above = sum(high)
    below = n - above
    if above and below:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * above * below / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-12))
        changes = 2 * _upper_tail(abs(runs - mean) / spread)
    else:
        changes = 2.0 ** (1 - n)
    middle = sum(values) / n
    square = sum((v - middle) ** 2 for v in values)
    if square:
        lag = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / square
        serial = 2 * _upper_tail(abs(lag + 1 / n) * math.sqrt(n))
    else:
        serial = 0.0
    return min(1.0, 3 * min(uniform, changes, serial))


def cell(p: float) -> int:
    """Place of a p-value on the logarithmic grid, rounded towards larger p; 0 is p = 1."""
    return int(-math.log(max(p, 1e-300)) * GRID)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ordered by start, then kind as listed."""
    found = []
    if (":" in text or "=" in text) and any(w in low for low in (text.lower(),) for w in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    for run in _RUN.finditer(text):  # both other patterns lie inside such a run when they are long enough
        at, word = run.start(), run[0]
        if "AKIA" in word:
            found += [(at + m.start(), at + m.end(), "access") for m in _ACCESS.finditer(word) if len(m[0]) >= 16]
        if len(word) >= 32:
            found += [(at + m.start(), at + m.end(), "hex") for m in _HEX.finditer(word) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, grid cell) of every run that could be encoded key material."""
    out = []
    for run in _RUN.finditer(text):
        word = run[0].rstrip("=")
        if len(word) < MIN_LENGTH or "=" in word:
            for part in re.finditer(r"[^=]+", word):  # name=value and the like
                if len(part[0]) >= MIN_LENGTH:
                    out += _candidate(run.start() + part.start(), part[0])
        else:
            out += _candidate(run.start(), word)
    return out


def _candidate(at: int, word: str) -> list[tuple[int, int, int, int]]:
    name = encoding(word)
    if name is None or len(word) * math.log2(len(_PLACES[name])) < MIN_BITS:
        return []
    return [(at, at + len(word), len(word).bit_length(), cell(battery(word, name)))]


def cutoffs(df: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """For each class of lengths the first grid cell that is judged not random; from all rows."""
    def count(batches):
        seen: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for _, _, size, place in candidates(value or ""):
                    seen[size, place] += 1
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([seen[k] for k in keys], pa.int64())], names=["size", "place", "n"])

    cells = (df.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "size int, place int, n long")
             .groupBy("size", "place").agg(F.sum("n").alias("n")))
    by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row in cells.toLocalIterator():  # at most 31 classes of at most 44 210 cells, whatever the input
        by_size[row["size"]].append((row["place"], row["n"]))
    out = {}
    for size, places in by_size.items():
        total, smaller, cut = sum(n for _, n in places), 0, None
        for place, n in sorted(places, reverse=True):  # from the least p-value up
            smaller += n
            if math.exp(-place / GRID) <= smaller * rate / total:
                cut = place
        out[size] = 1 << 30 if cut is None else cut
    return out


def all_spans(text: str, cuts: dict[int, int]) -> list[tuple[int, int, str]]:
    """Base spans and the random runs that overlap none of them."""
    spans = base_spans(text)
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
    found = [(start, end, "random") for start, end, size, place in candidates(text) if place < cuts.get(size, 1 << 30)]
    for start, end, kind in found:  # runs overlap no other, so the fixed spans that begin before a run's end are all that count
        before = bisect_left(starts, end)
        if not (before and reach[before - 1] > start):
            spans.append((start, end, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(df: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``df`` without ``text``, plus n_assign, n_access, n_hex, base_sha256 and spans."""
    cuts = cutoffs(df, text, rate)

    def compute(values):
        out = [[], [], [], [], []]
        for value in values:
            spans = all_spans(value or "", cuts)
            base = [s for s in spans if s[2] != "random"]
            for k in range(3):
                out[k].append(sum(s[2] == KINDS[k] for s in base))
            out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out[4].append(joined(spans))
        return out

    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return extend(df, text, fields, compute)


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``df`` with every span (overlaps merged) replaced by ``mask``; a null text stays null."""
    cuts = cutoffs(df, text, rate)

    def clean(value):
        if value is None:
            return None
        parts, at = [], 0
        for start, end, _ in all_spans(value, cuts):
            if start >= at:
                parts += [value[at:start], mask]
            at = max(at, end)
        return "".join(parts) + value[at:]

    order = df.columns
    return extend(df, text, [T.StructField(text, T.StringType())], lambda values: [[clean(v) for v in values]]).select(
        *[F.col(f"`{c}`") for c in order])


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
