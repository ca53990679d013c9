"""Toxicity: boosted trees over dense features, calibrated isotonically.

Fitting uses a sample of at most ``SAMPLE`` labelled rows (those with the smallest hashes of their ids).  From it come
the lexicon, terms that occur in significantly more toxic documents than chance allows (whole words, and word beginnings
of 4 to 6 letters for inflected forms), and the weights of its terms, the logarithms of their odds.  Per text: densities
of lexicon hits, their nearness to second-person pronouns, capitals, punctuation, obfuscation, and hits that appear only
once obfuscation is undone.  Gradient-boosted trees are fitted on three quarters of the sample and their margin is
calibrated on the rest.  Feature extraction and scoring run over all rows where they lie, in time linear in the text, however
long its words are.

Null and empty texts have the features of an empty text and a score like any other.  A sample without both classes gives
every text the share of toxic rows in it, 0 if it is empty.  Labels of one id that differ count as toxic; null labels
and labels without a document are not used.  Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, free_name, query, remainder, table
from quadrille.plans.staging import stage

SAMPLE, MIN_DOCS = 20_000, 4
TREES, DEPTH, STEP, SEED = 30, 3, 0.2, 17
CACHE_WORDS, CACHE_LETTERS = 100_000, 64

_WORD = re.compile(r"[^\W\d_]+")
_SEPARATORS = "@$!*.+_-"
_RUN = re.compile(r"[\w@$!*.+-]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_PUNCTUATION = re.compile(r"[^\w\s]+")
_CAPITALS = re.compile(r"\b[A-Z]{2,}\b")
#: Pronouns of the second person, and look-alikes of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu toi te ton ta tes vous votre vos "
                          "usted ustedes ti tus vosotros vuestro vuestra".split())
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = ("size", "weight_density", "hit_density", "hits", "heaviest", "nearest_you", "near_you", "you_density", "capitals",
            "shouted", "exclaims", "questions", "punctuation", "mixed", "repeated", "hidden_density", "hidden_heaviest")


def terms_of(word: str) -> list[str]:
    """The word itself (marked by a blank at its end) and its beginnings."""
    return [word + " "] + [word[:n] for n in (4, 5, 6) if len(word) >= n]


class Weights(dict):
    """Weight of a lower-case word: that of its heaviest term in the lexicon, or 0."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = max([self.lexicon.get(t, 0.0) for t in terms_of(word)])
        if len(word) <= CACHE_LETTERS:
            if len(self) > CACHE_WORDS:
                self.clear()
            self[word] = weight
        return weight


def mixed_words(lowered: str) -> list[str]:
    """Words with separators or digits inside: runs of both that start and end with a letter or digit."""
    found = []
    for piece in [p for p in lowered.split() if not p.isalpha() and not p[:-1].isalpha()]:
        for run in _RUN.findall(piece):
            run = run.strip(_SEPARATORS)
            if not run.isalnum() and run or any(map(str.isdecimal, run[1:-1])):
                found.append(run)
    return found


def features(text: str | None, weights: Weights) -> list[float]:
    text = text or ""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    n, chars = max(len(words), 1), max(len(text), 1)
    found = list(map(weights.__getitem__, words))
    hits = [i for i, w in enumerate(found) if w > 0]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = []
    for i in hits:
        k = _bisect(you, i)
        near.append(min([abs(i - j) for j in you[max(0, k - 1):k + 1]], default=1000))
    mixed = mixed_words(lowered)
    hidden = [weights[_NOT_LETTERS.sub("", m.translate(_LOOKALIKE))] for m in mixed]
    shouted, letters = _CAPITALS.findall(text), max(sum(map(len, words)), 1)
    return [math.log1p(len(words)), sum(found) / n, len(hits) / n, math.log1p(len(hits)), max(found, default=0.0),
            max((math.exp(-d / 5) for d in near), default=0.0), sum(math.exp(-d / 5) for d in near) / n, len(you) / n,
            sum(map(len, shouted)) / letters, len(shouted) / n, text.count("!") / chars, text.count("?") / chars,
            sum(map(len, _PUNCTUATION.findall(text))) / chars, len(mixed) / n, len(_REPEATED.findall(text)) / n,
            sum(hidden) / n, max(hidden, default=0.0)]


def _bisect(places: list[int], at: int) -> int:
    low, high = 0, len(places)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if places[middle] < at else (low, middle)
    return low


def sample_labels(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` (doc_id, toxic) rows, one per id, without those held out (crc32 of the id modulo 5 is 0)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    return (known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], int, int]:
    """Terms and weights, and how many rows and toxic rows of ``sample`` (text, toxic) there are.

    A term is kept if the likelihood ratio of its toxic share against the overall one exceeds the logarithm of the
    number of terms tried, which keeps chance terms out whatever the size of the sample.
    """
    def count(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                for term in {""} | set(chain.from_iterable(map(terms_of, words))):
                    pair = seen[term]
                    pair[0] += 1
                    pair[1] += toxic > 0
            if len(seen) > CACHE_WORDS:
                yield flush(seen)
                seen.clear()
        yield flush(seen)

    def flush(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
                                           pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "n", "bad"])

    counts = (sample.select("text", "toxic").mapInArrow(count, "term string, n long, bad long")
              .groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    counts = stage(counts.filter((F.col("n") >= MIN_DOCS) | (F.col("term") == "")), "terms")
    total = counts.filter("term = ''").first()
    if total is None or total["bad"] in (0, total["n"]):
        return {}, total["n"] if total else 0, total["bad"] if total else 0
    rate, tried = total["bad"] / total["n"], max(counts.count(), 2)
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    gain = part(F.col("bad"), F.col("n") * rate) + part(F.col("n") - F.col("bad"), F.col("n") * (1 - rate))
    weight = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - math.log(rate / (1 - rate))
    chosen = (counts.filter(F.col("term") != "").select("term", gain.alias("gain"), weight.alias("weight"))
              .filter((F.col("gain") > math.log(tried)) & (F.col("weight") > 1)))  # of the sample's terms, so bounded by it
    return {r["term"]: r["weight"] for r in chosen.collect()}, total["n"], total["bad"]


class Scorer:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], constant: float | None):
        self.lexicon, self.constant = lexicon, constant
        self.trees = self.isotonic = None

    def with_features(self, df: DataFrame, text: str, into: str) -> DataFrame:
        lexicon = self.lexicon
        held: list[Weights] = []

        def compute(values):
            if not held:
                held.append(Weights(lexicon))
            return [[features(v, held[0]) for v in values]]

        return extend(df, text, [T.StructField(into, T.ArrayType(T.DoubleType()))], compute, keep=True)

    def margin(self, df: DataFrame, into: str) -> DataFrame:
        """``features`` exchanged for the trees' probability before calibration."""
        kept = [c for c in df.columns if c != "features"]
        scored = self.trees.transform(df.withColumn("features", array_to_vector("features")))
        return scored.select(*kept, vector_to_array("probability")[1].alias(into))

    def score(self, df: DataFrame, text: str = "text", into: str = "score", keep: bool = False) -> DataFrame:
        """``df`` without ``text`` (unless ``keep``), plus ``into``: the calibrated score of every row."""
        carried = [c for c in df.columns if c != into and (keep or c != text)]
        if self.constant is not None:
            return df.select(*[F.col(f"`{c}`") for c in carried], F.lit(self.constant).alias(into))
        places = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names that clash with none of the columns made below
        work = df.select(*[F.col(f"`{c}`").alias(place) for c, place in places.items() if c == text or c in carried])
        work = self.with_features(work, places[text], "features")
        if not keep:
            work = work.drop(places[text])
        scored = self.isotonic.transform(self.margin(work, "margin"))
        result = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
        return scored.select(*[F.col(places[c]).alias(c) for c in carried], result.alias(into))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Scorer:
    """Fits on the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    chosen = sample_labels(labels, size)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``size`` rows are broadcast
    sample = stage(rows, "toxicity-sample")
    lexicon, n, bad = learn_lexicon(sample)
    if bad in (0, n):
        return Scorer({}, float(bad) / n if n else 0.0)
    scorer = Scorer(lexicon, None)
    rows = stage(scorer.with_features(sample, "text", "features"), "toxicity-features")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0
    train = rows.filter(~fold)
    if train.agg(F.count_distinct("toxic")).first()[0] < 2:
        train = rows
    boosted = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
    train = train.withColumn("features", array_to_vector("features")).repartition(4).cache()
    scorer.trees = boosted.fit(train)
    train.unpersist()
    held = rows.filter(fold)
    if held.agg(F.count_distinct("toxic")).first()[0] < 2:
        held = rows
    calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="calibrated")
    scorer.isotonic = calibration.fit(scorer.margin(held, "margin"))
    return scorer


def reject_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, columns unchanged."""
    score = free_name(docs, "toxicity")
    scored = fit(training, labels).score(docs, "text", score, keep=True)
    return scored.filter(F.col(score) < cut).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
