"""Bulk marking of elements: known cases and a brute-force comparison."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators.marking import Params, Status, mark


def indicators(spark, error, ratio=None, length=None, growth=None):
    n = len(error)
    rows = [(i, float(error[i]), float((ratio or [2.0] * n)[i]), float((length or [1.0] * n)[i]),
             int((growth or [3] * n)[i])) for i in range(n)]
    return spark.createDataFrame(rows, "elem_id int, error double, ratio double, length double, growth int")


def ids(df, by_error=False):
    order = [F.desc("e2"), "elem_id"] if by_error else ["elem_id"]
    return [r["elem_id"] for r in df.orderBy(*order).collect()]


def reference(error, ratio, growth, p):
    """Sequential marking in plain Python."""
    n, total = len(error), sum(e * e for e in error)
    order = sorted((i for i in range(n) if ratio[i] > 1), key=lambda i: (-error[i] ** 2, i))
    marked, cum = order, 0.0
    for k, i in enumerate(order):
        cum += error[i] ** 2
        if total and cum / total >= p.theta:
            marked = order[: k + 1]
            break
    chosen = marked[: math.ceil(p.max_refine_fraction * n)]
    if p.max_elements > 0:
        used, kept = 0, []
        for i in chosen:
            used += growth[i]
            if used > p.max_elements - n:
                break
            kept.append(i)
        chosen = kept
    return marked, chosen


def test_flagged_and_statuses(spark):
    m = mark(indicators(spark, [1] * 5, [2, 1, math.nan, 1.0000001, 0]))
    assert ids(m.flagged) == [0, 3]
    assert mark(indicators(spark, [1] * 4, [0.5] * 4)).status is Status.NO_CANDIDATES
    p = Params(1.0, 1.0, min_element_length=1.0)
    assert ids(mark(indicators(spark, [1] * 4, length=[3, 2, 2.0000001, 5]), p).candidates) == [0, 2, 3]
    assert mark(indicators(spark, [1] * 4, length=[2, 1, 0.5, 2]), p).status is Status.FLOOR_EXHAUSTED


def test_order_and_caps(spark):
    m = mark(indicators(spark, [1, 3, 1, 3, 2, 1]), Params(1.0, 1.0))
    assert ids(m.marked, by_error=True) == [1, 3, 4, 0, 2, 5]
    m = mark(indicators(spark, [1, 1, 10, 10], [2, 2, 0, 0]), Params(0.5, 1.0))
    assert ids(m.marked) == [0, 1]
    rows = indicators(spark, range(1, 11), growth=[7] * 10)
    assert ids(mark(rows, Params(1.0, 0.25)).selected, by_error=True) == [9, 8, 7]
    for ceiling, want in ((37, [9, 8, 7]), (31, [9, 8, 7]), (16, []), (17.5, [9]), (0.5, []), (-3, [9, 8, 7])):
        m = mark(rows, Params(1.0, 0.25, max_elements=ceiling))
        assert ids(m.selected, by_error=True) == want
        assert m.status is (Status.SELECTED if want else Status.ELEMENT_CEILING)
    assert len(ids(mark(rows, Params(1.2, 1.0)).marked)) == 10
    assert ids(mark(rows, Params(0.0, 1.0)).marked) == [9]
    assert len(ids(mark(indicators(spark, [0] * 4), Params(0.5, 1.0)).marked)) == 4


def test_rejects(spark):
    for bad in (dict(theta=math.nan), dict(theta=-0.1), dict(min_element_length=math.nan),
                dict(max_elements=math.inf), dict(max_refine_fraction=0)):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        mark(indicators(spark, [1, math.nan]))
    with pytest.raises(ValueError):
        mark(indicators(spark, [1.0]).drop("length"), Params(min_element_length=1.0))


@pytest.mark.parametrize("seed", range(4))
def test_against_sequential_marking(spark, seed):
    """Half of the elements share one error, so ties straddle every cut."""
    rng = random.Random(seed)
    n = 300
    error = [rng.randrange(50) if rng.random() < 0.5 else 20 for _ in range(n)]
    ratio = [2.0 if rng.random() < 0.6 else 0.5 for _ in range(n)]
    growth = [rng.choice([3, 7, 9]) for _ in range(n)]
    p = Params(rng.choice([0.2, 0.5, 0.9]), rng.choice([0.1, 0.3]), max_elements=n + rng.randrange(50, 400))
    m = mark(indicators(spark, error, ratio, growth=growth), p)
    marked, chosen = reference(error, ratio, growth, p)
    assert ids(m.marked, by_error=True) == marked
    assert ids(m.selected, by_error=True) == chosen


def test_an_element_given_twice_is_refused(spark):
    rows = indicators(spark, [1.0, 2.0])
    with pytest.raises(ValueError, match="more than one error"):
        mark(rows.union(rows.limit(1)))


def test_mark_marked_goes_on_to_its_whole_target(spark, tmp_path):
    """Two in five of the squared errors are to be marked, however many elements that takes."""
    from quadrille.workload.registry import QUERIES

    draw = random.Random(8)
    rows = [(k, draw.randrange(1, 500), 100.0 * draw.randrange(1, 900)) for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    error = {k: price // 100 for k, _, price in rows}
    fit = [k for k, c, _ in rows if k % 97 and k * 104729 % 10 < 4 and 1 + c % 8 > 3]
    total, cum, expected = sum(e * e for e in error.values()), 0, []
    for k in sorted(fit, key=lambda k: (-error[k] ** 2, k)):
        if expected and cum / total >= 0.4:
            break
        expected.append(k)
        cum += error[k] ** 2
    assert {r["elem_id"] for r in QUERIES["mark_marked"](spark, str(tmp_path)).collect()} == set(expected)
