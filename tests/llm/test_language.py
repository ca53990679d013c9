"""Held-out accuracy, mixtures, and texts without letters."""

import numpy as np

from helpers import documents
from quadrille.llm import language as L


def test_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in L.op1_language(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(got) == len(truth) and len(held) > 30
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixture_and_odd_texts(spark):
    a, b = "the cat and the dog sat on the mat with that other cat ", "der hund und die katze sind auf der matte mit dem vogel "
    training = [(k, (a if k % 2 else b) * 5) for k in range(40)]
    docs = documents(spark, training).selectExpr("doc_id", "text", "if(doc_id % 2 = 1, 'en', 'de') AS lang")
    names, theta = L.learn(docs.union(spark.createDataFrame([(90, "foo", None), (91, None, "en")], "doc_id long, text string, lang string")))
    assert names == ["de", "en"] and np.allclose(theta.sum(axis=1), 1)
    rows = [(1, a * 30), (2, a * 60 + b * 60), (3, None), (4, ""), (5, "123 !?"), (6, b * 4000), (1, a * 30), (7, "é")]
    found = L.predict(documents(spark, rows, score="clash", Languages="clash"), names, theta).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and got[1]["lang_pred"] == "en" and got[6]["lang_pred"] == "de"
    assert abs(got[2]["languages"]["en"] - 0.5) < 0.1 and abs(got[2]["languages"]["de"] - 0.5) < 0.1
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[3]["score"] == 0
    empty = L.learn(docs.limit(0))
    assert empty[0] == [] and {r["lang_pred"] for r in L.predict(documents(spark, rows), *empty).collect()} == {"und"}


def test_whole_texts_are_counted():
    text = "ab " * 400_000
    assert L.gram_counts(text).sum() == 3 * len(text) - 3
    assert (L.gram_counts("abc" * 300_000)[L.gram_counts("abc" * 30) > 0] > 1000).all()
