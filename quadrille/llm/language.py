"""Language identification as inference of a multilingual mixture.

A language is a distribution over hashed n-grams of one to three bytes of lower-cased text in which everything but
letters is a blank.  A document's n-grams are a mixture of those distributions; expectation-maximisation estimates its
proportions.  The set of languages starts with the likeliest one and grows by the language that raises the likelihood
most as long as the gain exceeds a penalty per language (overlapping n-grams of three orders count a third).  A language
whose directional derivative at the current mixture is not positive cannot raise the likelihood (it is concave), so it
is passed over without a trial.

Distributions are learned from a sample of about ``SAMPLE`` documents a language, drawn by a hash of their ids.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no language could be learned.
Repeated rows get equal results; ties go to the language whose name sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, query, remainder, table
from quadrille.llm.text import CHUNK

BUCKETS, SAMPLE, SMOOTHING = 1 << 15, 4000, 0.5
STEPS, PENALTY = 25, 3.0
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    data = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), CHUNK):
        piece = np.frombuffer(data[at:at + CHUNK + 2], np.uint8).astype(np.uint32)
        own = min(CHUNK, len(data) - at)
        two = piece[:-1] * np.uint32(257) + piece[1:] + np.uint32(1 << 12)
        three = two[:-1] * np.uint32(257) + piece[2:] + np.uint32(7)
        total += np.bincount(np.concatenate([_bucket(piece[:own]), _bucket(two[:own]), _bucket(three[:own])]), minlength=BUCKETS)
    return total


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def proportions(weights: np.ndarray, theta: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Mixture proportions of the rows of ``theta`` under n-gram counts, and the log-likelihood, by EM."""
    share = np.full(len(theta), 1 / len(theta)) if start is None else start
    total, before = weights.sum(), -np.inf
    for _ in range(STEPS):
        mixed = share @ theta
        now = float(weights @ np.log(mixed))
        if now - before < 1e-4 * max(1.0, total / 1000):
            break
        before = now
        share = share * (theta @ (weights / mixed)) / total
    return share, float(weights @ np.log(share @ theta))


def identify(text: str | None, theta: np.ndarray) -> np.ndarray | None:
    """Proportions over all languages; None for a text without letters."""
    if text is None or not len(theta) or not any(map(str.isalpha, text)):
        return None
    counts = gram_counts(text)
    seen = np.flatnonzero(counts)
    weights, local = counts[seen].astype(float), theta[:, seen]
    alone = np.log(local) @ weights
    chosen, share = [int(np.argmax(alone))], np.ones(1)
    value, total = float(alone[chosen[0]]), weights.sum()
    while len(chosen) < len(theta):
        slope = local @ (weights / (share @ local[chosen])) - total
        best = None
        for extra in np.flatnonzero(slope > 0):
            if extra in chosen:
                continue
            trial = chosen + [int(extra)]
            found, likelihood = proportions(weights, local[trial], np.append(share * 0.9, 0.1))
            if best is None or likelihood > best[0]:
                best = (likelihood, trial, found)
        if best is None or (best[0] - value) / 3 <= PENALTY * np.log(total + 1):
            break
        value, chosen, share = best
    out = np.zeros(len(theta))
    out[chosen] = share
    return out


def learn(docs: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram distributions from ``docs`` (doc_id, text, lang); null languages are left out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) * F.col("rows") < per_language * (1 << 20)
    sample = known.join(F.broadcast(sizes), "lang").filter(draw).select("lang", "text")  # a row per language is broadcast

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang] = seen.get(lang, 0) + gram_counts(text)
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])],
                                             names=["lang", "bucket", "n"])

    rows = (sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n")).toPandas())  # at most BUCKETS rows a language
    names = sorted(rows["lang"].unique())
    table_ = np.full((len(names), BUCKETS), SMOOTHING)
    place = {n: i for i, n in enumerate(names)}
    table_[rows["lang"].map(place).to_numpy(int), rows["bucket"].to_numpy(int)] += rows["n"].to_numpy(float)
    return names, table_ / table_.sum(axis=1, keepdims=True)


def predict(df: DataFrame, names: list[str], theta: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` without ``text``, plus lang_pred, score (its proportion) and languages (name and proportion of each)."""
    shared = df.sparkSession.sparkContext.broadcast(theta)  # languages x BUCKETS numbers

    def compute(values):
        best, score, every = [], [], []
        for value in values:
            share = identify(value, shared.value)
            if share is None:
                best.append("und"), score.append(0.0), every.append({})
            else:
                k = int(np.argmax(share))
                best.append(names[k]), score.append(min(1.0, float(share[k])))
                every.append({names[i]: float(share[i]) for i in np.flatnonzero(share)})
        return [best, score, [list(e.items()) for e in every]]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))]
    return extend(df, text, fields, compute)


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    names, theta = learn(docs.filter(~held_out))
    scored = predict(docs.select("doc_id", "text"), names, theta)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")
