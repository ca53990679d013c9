"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text.  Votes of all rows are counted by pattern (at most 3 to the
number of labellers patterns, whatever the corpus), and expectation-maximisation estimates from the counts how often
each labeller gives each vote on good and on bad texts, and the share of good ones.  The posterior of a pattern is the
label of the rows that show it; a linear scorer over hashed features of words and their shapes is trained on the
posteriors of a sample of about ``SAMPLE`` rows and applied to all.  Texts are read once: votes and features are written.

Null and empty texts have no words: every labeller abstains, the posterior is the prior, and the score is that of no
features.  Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, query, table
from quadrille.plans.staging import stage

SAMPLE, BUCKETS, EPOCHS, RIDGE = 8_000, 1 << 14, 80, 1e-5
EM_STEPS, CACHE_WORDS = 200, 300_000
GOOD, BAD, ABSTAIN = 1, -1, 0
_CLEAN = re.compile(r"""["'(]?[^\W\d_]+(?:['-][^\W\d_]+)*[)"']?[.,;:!?]?["')]?""")
_RUNS = re.compile(r"(.)\1+")
_SYMBOLS = re.compile(r"[#%$&*|~^<>{}=\\@+_!\[\]]")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("the of and to in a is that for it on as with was be by are this from or der die das und in den von zu mit ist im "
                           "für ein eine auf dem des nicht le la les de des et en un une est que dans pour par sur au avec qui el los las "
                           "y del se por con para su es lo como".split())


class Kinds(dict):
    """A letter's kind by its code point: A for capitals, a for other letters, 0 for digits, anything else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = Kinds()


class Words(dict):
    """What is known of a word: whether it is clean and whether a function word, its letters, capitals and symbols, and its
    hashed features (itself if it is short, its shape, its end)."""

    def __missing__(self, word: str) -> tuple:
        if len(self) > CACHE_WORDS:
            self.clear()
        kinds = word.translate(_KINDS)
        shape = _RUNS.sub(r"\1+", kinds)
        features = ((word,) if len(word) <= 4 else ()) + ("s" + shape, "e" + word[-2:])
        capitals = kinds.count("A")
        made = self[word] = ((_CLEAN.fullmatch(word) is not None, word.lower().strip(".,") in FUNCTION_WORDS, capitals + kinds.count("a"),
                              capitals, len(_SYMBOLS.findall(word))), [_bucket(f) for f in features])
        return made


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS


def _vote(bad: bool, good: bool = False) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


LABELLERS = ("symbols", "capitals", "distinct words", "clean words", "top word", "word length", "function words", "letters",
             "repeated runs", "repeated words", "compression")
#: Bases of a feature for every level of a word's share of its text.
_LEVELS = np.array([_bucket(f" level {k}") for k in range(12)])
_BIAS, _SHORT = _bucket(" bias"), _bucket(" short")


def analyse(text: str | None, known: Words) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """The labellers' votes, in the order of LABELLERS, and the text's hashed features as buckets and values."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (ABSTAIN,) * len(LABELLERS), np.array([_BIAS]), np.ones(1)
    counts = Counter(words)
    facts = [known[w] for w in counts]
    share = np.fromiter(counts.values(), float, len(counts)) / n
    clean, common, letters, capitals, symbols = share @ np.array([f[0] for f in facts], float)  # per word of the text
    chars = len(text) / n
    long_enough = n >= 20
    distinct, top = len(counts) / n, float(share.max())
    threes = len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1)
    again = sum(map(str.__eq__, words, words[1:])) / n
    packed = len(zlib.compress(text.encode("utf-8", "replace"), 1)) / len(text)
    cast = (_vote(symbols > 0.04 * chars, symbols < 0.002 * chars), _vote(capitals > 0.4 * letters),
            _vote(long_enough and distinct < 0.3, long_enough and distinct > 0.55), _vote(clean < 0.7, clean > 0.95),
            _vote(long_enough and top > 0.2), _vote(letters < 2 or letters > 8),
            _vote(long_enough and common < 0.02, common > 0.1), _vote(letters < 0.6 * chars),
            _vote(long_enough and threes < 0.6, long_enough and threes > 0.9), _vote(long_enough and again > 0.1),
            _vote(long_enough and packed < 0.2, long_enough and packed > 0.3))
    features = [f[1] for f in facts]
    level = _LEVELS[np.clip(np.log2(share * 1024).astype(int), 0, 11)] if long_enough else np.full(len(share), _SHORT)
    at = np.concatenate([np.array([b for f in features for b in f], np.int64), level, [_BIAS]])
    value = np.concatenate([np.repeat(share, [len(f) for f in features]), share, [1.0]])
    kept, place = np.unique(at, return_inverse=True)
    return cast, kept, np.bincount(place, value)


class Labels:
    """Estimated accuracies: ``given[c, j, v + 1]`` is the chance that labeller j, if it votes, votes v on class c
    (1: good)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        m = patterns.shape[1] if len(patterns) else len(LABELLERS)
        self.prior, self.given = 0.5, np.full((2, m, 3), 1 / 3)
        if not len(patterns):
            return
        onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
        belief = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
        for _ in range(EM_STEPS):
            weight = np.stack([(1 - belief) * counts, belief * counts])
            self.prior = float(np.clip(weight[1].sum() / counts.sum(), 1e-3, 1 - 1e-3))
            given = np.einsum("cp,pjv->cjv", weight, onehot) + 1.0
            self.given = given / given[:, :, [0, 2]].sum(axis=2, keepdims=True)  # among the votes that were cast
            new = self.posterior(patterns)
            if np.abs(new - belief).max() < 1e-6:
                break
            belief = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good under each pattern of votes."""
        at = np.arange(patterns.shape[1])
        logs = np.log(self.given)
        logs[:, :, 1] = 0.0  # abstaining says nothing
        bad, good = (logs[c, at, patterns + 1].sum(axis=1) for c in (0, 1))
        gap = good - bad + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))


def examine(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus votes, feature_at and feature_value (packed int16 buckets and float32 values)."""
    words = Words()

    def compute(values):
        made = [analyse(v, words) for v in values]
        return [[list(m[0]) for m in made], [m[1].astype("<i2").tobytes() for m in made], [m[2].astype("<f4").tobytes() for m in made]]

    fields = [T.StructField("votes", T.ArrayType(T.ByteType())), T.StructField("feature_at", T.BinaryType()),
              T.StructField("feature_value", T.BinaryType())]
    return extend(df, text, fields, compute)


def learn_labels(examined: DataFrame) -> tuple[Labels, int]:
    """Accuracies from the vote patterns of all rows, and the number of rows."""
    rows = examined.groupBy("votes").count().collect()  # at most 3^11 patterns
    rows.sort(key=lambda r: tuple(r["votes"]))
    patterns = np.array([list(r["votes"]) for r in rows], int).reshape(len(rows), len(LABELLERS))
    counts = np.array([r["count"] for r in rows], float)
    return Labels(patterns, counts), int(counts.sum())


def train(examined: DataFrame, labels: Labels, rows: int, size: int = SAMPLE) -> np.ndarray:
    """Weights of the linear scorer, from a sample of about ``size`` rows drawn by a hash of their features."""
    draw = F.pmod(F.xxhash64(F.lit("quality"), *[F.col(c) for c in examined.columns]), F.lit(1 << 20))
    got = examined.filter(draw * max(rows, 1) < size * (1 << 20)).select("votes", "feature_at", "feature_value").collect()
    got.sort(key=lambda r: (bytes(r["feature_at"]), bytes(r["feature_value"])))  # sums do not depend on the tasks' order
    weights = np.zeros(BUCKETS)
    if not got:
        return weights
    belief = labels.posterior(np.array([list(r["votes"]) for r in got], int))
    at = np.frombuffer(b"".join(r["feature_at"] for r in got), "<i2").astype(int)
    value = np.frombuffer(b"".join(r["feature_value"] for r in got), "<f4").astype(float)
    sizes = np.array([len(r["feature_at"]) // 2 for r in got])
    row, starts = np.repeat(np.arange(len(got)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    squares = np.full(BUCKETS, 1e-8)
    for _ in range(EPOCHS):
        chance = 1 / (1 + np.exp(-np.clip(np.add.reduceat(value * weights[at], starts), -50, 50)))
        slope = np.bincount(at, value * (chance - belief)[row], BUCKETS) / len(got) + RIDGE * weights
        squares += slope * slope
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


def assess(examined: DataFrame, labels: Labels, weights: np.ndarray, cut: float = 0.5) -> DataFrame:
    """``examined`` with its features exchanged for posterior, score and keep."""
    shared = examined.sparkSession.sparkContext.broadcast((labels, weights))
    carried = [c for c in examined.columns if c.lower() not in ("posterior", "score", "keep", "votes", "feature_at", "feature_value")]
    made = [T.StructField("votes", T.ArrayType(T.ByteType())), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()),
            T.StructField("keep", T.BooleanType())]
    schema = T.StructType([examined.schema[c] for c in carried] + made)
    n = len(carried)

    def run(batches):
        known, linear = shared.value
        for batch in batches:
            patterns = np.array(batch.column(n).to_pylist(), int).reshape(batch.num_rows, -1)
            scores = np.array([np.frombuffer(v, "<f4") @ linear[np.frombuffer(a, "<i2")]
                               for a, v in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())])
            scores = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n + 1)] + [pa.array(known.posterior(patterns)), pa.array(scores),
                                                                                        pa.array(scores >= cut)], names=schema.names)

    return examined.select(*[F.col(f"`{c}`") for c in carried], "votes", "feature_at", "feature_value").mapInArrow(run, schema)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    examined = stage(examine(table(spark, sf_dir, "documents").select("doc_id", "text")), "examined")
    labels, rows = learn_labels(examined)
    return assess(examined, labels, train(examined, labels, rows)).select("doc_id", "posterior", "score", "keep", "votes")
