"""Weak labels: recovered accuracies, the query against the labels it never saw, and odd texts."""

import numpy as np

from helpers import documents
from quadrille.llm import quality as Q


def test_accuracies_are_recovered():
    rng = np.random.RandomState(1)
    truth = rng.rand(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(rng.rand(len(truth)) < a, 1, -1) * np.where(truth, 1, -1) * (rng.rand(len(truth)) < 0.8) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    labels = Q.Labels(patterns.astype(int), counts.astype(float))
    assert abs(labels.prior - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(labels.given[1, j, 2] - a) < 0.04 and abs(labels.given[0, j, 0] - a) < 0.04
    assert np.mean((labels.posterior(votes.astype(int)) > 0.5) == truth) > 0.9


def test_query_against_labels(spark, sf):
    rows = Q.op4_quality(spark, sf).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["keep"] == bool(truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]) >= 0.93


def test_odd_texts(spark):
    good = "The river was green and the light of summer lay on the old stone house by the road where they walked. "
    rows = [(k, good + f"Item {chr(97 + k % 26)} was of the {chr(98 + k % 24)} kind and not that large. " * 1) for k in range(60)]
    rows += [(100 + k, "BUY!!! NOW$$$ ### @@@ " * 12) for k in range(20)] + [(200, None), (201, ""), (202, "spam " * 50_000), (3, rows[3][1])]
    docs = documents(spark, rows, votes="clash", score="clash", lang="en")
    examined = Q.examine(docs)
    labels, n = Q.learn_labels(examined)
    found = Q.assess(examined, labels, Q.train(examined, labels, n)).collect()
    got = {r["doc_id"]: r for r in found}
    assert n == len(rows) == len(found)
    assert all(got[k]["keep"] for k in range(60)) and not any(got[100 + k]["keep"] for k in range(20)) and not got[202]["posterior"] > 0.5
    assert got[200]["posterior"] == got[201]["posterior"] and set(got[200]["votes"]) == {0}
    none = Q.examine(docs.limit(0))
    labels, n = Q.learn_labels(none)
    assert n == 0 and Q.assess(none, labels, Q.train(none, labels, n)).count() == 0
