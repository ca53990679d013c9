"""Held-out accuracy, features, and samples without labels."""

import random
import re
import time

import numpy as np

from helpers import documents
from quadrille.llm import toxicity as X


def planted(spark, n=900):
    rng = np.random.RandomState(2)
    plain = ["the", "house", "river", "green", "walk", "table", "summer", "paper", "stone", "light"]
    rows, labels = [], []
    for k in range(n):
        words = rng.choice(plain, rng.randint(3, 60)).tolist()
        toxic = int(rng.rand() < 0.2)
        if toxic:
            words.insert(rng.randint(len(words)), rng.choice(["grumbus", "snorvel" + rng.choice(["a", "en", "ik"])]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_planted_terms(spark):
    rows, labels = planted(spark)
    docs = documents(spark, rows + [(10_000, None), (10_001, ""), (10_002, "walk " * 60_000), (3, rows[3][1])], score="clash", features="clash")
    table = spark.createDataFrame(labels + [(20_000, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    scorer = X.fit(docs, table)
    assert {"grumbus ", "snor"} <= set(scorer.lexicon)
    found = scorer.score(docs).collect()
    got = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())
    truth = dict(labels)
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in truth]) > 0.99
    assert got[10_000] < 0.5 and got[10_000] == got[10_001] and got[10_002] < 0.5
    kept = X.reject_toxic(docs, docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in [r["score"] for r in found])


def test_samples_without_two_classes(spark):
    rows, _ = planted(spark, 20)
    docs = documents(spark, rows)
    for labels, want in (([], 0.0), ([(k, 0) for k in range(20)], 0.0), ([(k, 1) for k in range(20)], 1.0)):
        scores = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).score(docs).collect()
        assert {r["score"] for r in scores} == {want} and len(scores) == 20
    assert X.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).score(docs.limit(0)).count() == 0


def test_features():
    weights = X.Weights({"idiot ": 5.0})
    got = dict(zip(X.FEATURES, X.features("YOU are an 1d10t, you idiot!! sooo", weights)))
    assert got["hits"] > 0 and got["nearest_you"] > 0.8 and got["hidden_heaviest"] == 5.0 and got["exclaims"] > 0 and got["repeated"] > 0
    assert X.features(None, weights) == X.features("", weights) and len(X.features("", weights)) == len(X.FEATURES)


def test_query(spark, sf):
    rows = X.op3_toxicity(spark, sf).collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.85  # few labels at this size
    assert not any(r["predicted"] and not truth[r["doc_id"]] for r in held)


def test_mixed_words_are_those_of_the_pattern_and_take_linear_time():
    pattern = re.compile(r"[^\W_]+(?:[@$!*.+_\d-]+[^\W_]+)+")
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice("ab1@._- ,²é") for _ in range(draw.randint(0, 14)))
        assert X.mixed_words(text) == pattern.findall(text)
    start = time.process_time()
    for text in ("a" * 1_000_000, "a1" * 500_000, "a." * 500_000, "." * 1_000_000):
        X.features(text, X.Weights({}))
    assert time.process_time() - start < 20


def test_score_keeps_text_and_clashing_columns(spark):
    rows, labels = planted(spark, 300)
    docs = documents(spark, rows, score="clash", features="clash", c0="x", probability="y")
    scorer = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kept = scorer.score(docs, "text", "toxicity", keep=True)
    assert kept.columns == [*docs.columns, "toxicity"]
    assert sorted(kept.select(*docs.columns).collect(), key=repr) == sorted(docs.collect(), key=repr)
