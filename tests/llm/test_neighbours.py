"""Nearest neighbours against all products."""

import numpy as np

from quadrille.llm import neighbours as N
from pyspark.sql import functions as F


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in good), default=1)
    good = [(i, np.pad(v, (0, dim - len(v)))) for i, v in good]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(N, "ROW_BLOCK", 150)
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    rng = np.random.RandomState(1)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, rows[3][1]) for i in range(600, 680)]  # a common vector, and ties
    rows += [(700, None), (720, []), (740, [0.0] * 24), (760, [1.0, None] * 12), (780, [float("nan")] * 24), (800, [float("inf")] * 24),
             (820, [1.0] * 5), (None, [1.0] * 24), (840, [1e30] * 24), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in N.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    want = brute(rows, 20)
    same = {(q, j) for q, _, j, _ in got} & {(q, j) for q, _, j, _ in want}
    assert len(got) == len(want) and len(same) >= 0.99 * len(want)
    assert N.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in N.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]


def test_query_recall(spark, sf):
    got = {(r["query_id"], r["vec_id"]) for r in N.op10_neighbours(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = {(q, j) for q, _, j, _ in brute([(r["vec_id"], list(r["embedding"])) for r in rows], 20)}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_bounds_hold():
    rng = np.random.RandomState(3)
    v, q = rng.standard_normal((4000, 48)), rng.standard_normal(48)
    q /= np.linalg.norm(q)
    u = v / np.linalg.norm(v, axis=1)[:, None] @ N.rotation(48)
    a = np.abs(u).sum(axis=1) / np.sqrt(48)
    estimate = np.where(u >= 0, 1, -1) @ (q @ N.rotation(48)) / np.sqrt(48) / a
    error = np.abs(estimate - v @ q / np.linalg.norm(v, axis=1))
    assert (error <= N.EPS * np.sqrt((1 - a * a) / (a * a * 47))).mean() > 0.998
