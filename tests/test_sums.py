"""Exact sums, thresholds that do not move with the partitioning, and subsets of an exact size."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quadrille.operators.marking import Params, mark, scalar_field
from quadrille.grid import Grid
from quadrille.operators.mesh import closure
from quadrille.operators.structured import structured
from quadrille.plans.selection import crossing, random_subset
from quadrille.plans.sums import FixedPoint, exact_sums


def table(spark, values, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double").repartition(parts)


@pytest.mark.parametrize("values", [
    [0.1] * 10, [1e16, 1.0, -1e16, 3.5], [2.0 ** 1023, 1.0, 2.0 ** 980], [5e-324, 5e-324], [0.0], [-2.5, 0.5],
    [random.Random(1).uniform(-1, 1) * 10 ** random.Random(i).randint(-6, 6) for i in range(300)]])
def test_total_is_the_exact_sum(spark, values):
    unit = FixedPoint.below(max(map(abs, values)))
    row = table(spark, values).agg(*unit.sums(F.col("v"))).first()
    want = sum(map(Fraction, values))
    assert abs(Fraction(unit.total(row)) / Fraction(2) ** unit.bits - want) <= len(values) * Fraction(2) ** -unit.bits
    assert unit.total(row) == sum(map(unit.units, values))
    got = exact_sums(table(spark, values), "v").first()["total"]
    assert math.isclose(got, float(want), rel_tol=1e-15, abs_tol=0)


def test_sums_by_group_nulls_and_empty(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", None), ("b", None), (None, 2.0), ("a", 0.2)], "k string, v double")
    assert {r["k"]: r["s"] for r in exact_sums(rows, "v", "k", name="s").collect()} == {"a": 0.1 + 0.2, "b": None, None: 2.0}
    assert exact_sums(rows.limit(0), "v", "k").count() == 0
    with pytest.raises(ValueError, match="finite"):
        exact_sums(table(spark, [math.inf]), "v")


def test_same_doubles_for_every_partitioning(spark):
    values = [random.Random(i).expovariate(1) ** 5 for i in range(5000)]
    sums = {exact_sums(table(spark, values, parts), "v").first()["total"] for parts in (1, 4, 211)}
    assert len(sums) == 1


def test_same_marks_for_every_partitioning(spark):
    """Theta lies on a running share, so a total that moves by one bit moves the mark."""
    rng = random.Random(3)
    error = [rng.random() for _ in range(3000)]
    order = sorted(range(3000), key=lambda i: (-error[i] * error[i], i))
    squares = [Fraction(error[i] * error[i]) for i in order]
    total, k = sum(squares), 700
    theta = float(sum(squares[:k]) / total)
    rows = spark.createDataFrame([(i, e, 2.0) for i, e in enumerate(error)], "elem_id int, error double, ratio double")
    for parts in (4, 211):
        assert {r["elem_id"] for r in mark(rows.repartition(parts), Params(theta, 1.0)).marked.collect()} == set(order[:k])
    cells = rows.selectExpr("CAST(elem_id AS BIGINT) AS code", "0 AS level", "error")
    cutoffs = {(f.refine_cutoff, f.coarsen_cutoff) for f in (
        scalar_field(cells.repartition(parts), Grid(2, 6), theta, 0.01, 0, 6) for parts in (4, 31))}
    reached = next(j for j in range(k - 1, k + 2) if sum(squares[:j]) >= Fraction(theta * float(total)))  # a rounded product
    assert len(cutoffs) == 1 and next(iter(cutoffs))[0] == error[order[reached - 1]]


def test_squares_beyond_a_double(spark):
    rows = spark.createDataFrame([(0, 1e200, 2.0)], "elem_id int, error double, ratio double")
    with pytest.raises(ValueError, match="1e154"):
        mark(rows)


def test_crossing_among_tiny_keys(spark):
    at = crossing(table(spark, [k * 5e-324 for k in range(10)]).withColumn("w", F.lit(1)), "v", "w", lambda c: c >= 4)
    assert (at.key, at.before, at.rows) == (3 * 5e-324, 3, 1)


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.3, 1.0])
def test_subset_has_its_size(spark, fraction):
    rows = table(spark, [0.0] * 1237)
    got = [r["id"] for r in random_subset(rows, fraction, "id").collect()]
    assert len(got) == len(set(got)) == math.ceil(fraction * 1237)
    assert sorted(got) == sorted(r["id"] for r in random_subset(rows.repartition(17), fraction, "id").collect())


def test_subsets_of_two_seeds_differ_and_bad_input(spark):
    rows = table(spark, [0.0] * 2000)
    a, b = ({r["id"] for r in random_subset(rows, 0.5, "id", seed).collect()} for seed in (1, 2))
    assert 400 < len(a & b) < 600 and 400 < sum(i < 1000 for i in a) < 600
    assert random_subset(rows.limit(0), 0.5, "id").count() == 0
    with pytest.raises(ValueError, match="fraction"):
        random_subset(rows, 1.5, "id")
    with pytest.raises(ValueError, match="NULL"):
        random_subset(rows.selectExpr("nullif(id, 3) AS id"), 0.5, "id")


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_of_random_subsets(spark, seed):
    """Closing again adds nothing, and a larger subset's closure holds the smaller one's."""
    mesh = structured(spark, (4, 4), (5, 5), (0, 0))
    listed = random_subset(mesh.elements.select("elem_id"), 0.4, "elem_id", seed)
    few = random_subset(listed, 0.5, "elem_id", seed)
    sets = [{r["elem_id"] for r in closure(mesh, df).collect()} for df in (listed, few)]
    again = closure(mesh, closure(mesh, listed))
    assert {r["elem_id"] for r in again.collect()} == sets[0] >= sets[1]
    assert {r["elem_id"] for r in listed.collect()} <= sets[0]
