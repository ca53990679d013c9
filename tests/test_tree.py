"""Refinement, coarsening, balance and invariants on known trees."""

import math

import pytest
from pyspark.sql import functions as F

from quadrille import Grid
from quadrille.operators import balance as B
from quadrille.operators import oracles as O
from quadrille.operators import tree as T
from quadrille.operators.marking import scalar_field
from quadrille.operators.points import encode_points, rejected_points, tree_of_points
from quadrille.operators.verify import InvalidTree, verify
from quadrille.plans.staging import stage

C = O.Config


def refined(spark, grid, oracle, passes=None):
    return stage(T.refine_converge(T.root(spark), grid, oracle, passes=passes))


# grid, oracle, passes, leaves before, after, ripple passes, violations before, region rule
CASES = {
    "circle": (Grid(2, 6), O.band(C(6, 0.3, coarse_level=2, fine_level=6)), None, 1252, 1444, 3, 152, 1516),
    "sphere": (Grid(3, 5), O.band(C(5, 0.3, coarse_level=2, fine_level=5)), None, 8520, 9304, 1, 3408, 10200),
    "tower_3d": (Grid(3, 6), O.tower(), None, 43, 232, 5, 180, 967),
    "crack": (Grid(2, 10), O.crack(10), None, 3070, 4600, 8, 1024, 6880),
    "third": (Grid(3, 5), O.hash_third(4), 5, 106, 232, 3, 240, 246),
    "quarter": (Grid(2, 8), O.hash_quarter(6), 8, 28, 52, 3, 10, None),
    "cloud": (Grid(3, 8), O.cloud(5), 8, 253, 855, 4, 1263, None),
}


@pytest.mark.parametrize("name", CASES)
def test_balance(spark, name):
    grid, oracle, passes, before, after, ripples, bad, region = CASES[name]
    leaves = refined(spark, grid, oracle, passes)
    assert leaves.count() == before
    assert B.violations(leaves, grid).agg(F.sum("violations")).first()[0] == bad
    swept = stage(B.balance(leaves, grid))
    assert swept.count() == after
    assert B.violations(swept, grid).isEmpty()
    verify(swept, grid)
    rippled = B.balance_passes(leaves, grid)
    assert rippled.passes == ripples
    assert T.same_leaves(rippled.leaves, swept)
    assert T.same_leaves(B.balance(leaves, grid, chain_rows=20), swept)
    if region:
        assert B.balance(leaves, grid, rule="region").count() == region


def test_balance_is_idempotent_and_keeps_the_root(spark):
    grid = Grid(2, 6)
    swept = stage(B.balance(refined(spark, grid, O.tower()), grid))
    assert T.same_leaves(B.balance(swept, grid), swept)
    assert B.balance_passes(swept, grid).passes == 0
    assert [tuple(r) for r in B.balance(T.root(spark), grid).collect()] == [(0, 0)]


def test_published_circle(spark):
    grid = Grid(2, 20)
    leaves = refined(spark, grid, O.band(C(20, coarse_level=3, fine_level=10)))
    assert leaves.count() == 171436
    assert B.balance(leaves, grid).count() == 174268


@pytest.mark.parametrize("dim", [2, 3])
def test_refine_and_coarsen(spark, dim):
    grid = Grid(dim, 3)
    once = T.refine(T.root(spark), grid, O.always())
    assert once.count() == 2**dim
    assert [tuple(r) for r in T.coarsen(once, grid, O.never()).collect()] == [(0, 0)]
    full = stage(T.refine_converge(T.root(spark), grid, O.always()))
    assert full.count() == 2 ** (3 * dim)
    assert not T.refine_changes(full, grid, O.always())
    tree = refined(spark, grid, O.graded())
    assert tree.count() == 2 * 2**dim - 1
    for _ in range(2):
        tree = stage(T.coarsen(tree, grid, O.never()))
    assert [tuple(r) for r in tree.collect()] == [(0, 0)]
    assert T.same_leaves(T.coarsen(full, grid, O.always()), full)


def test_verify_rejects(spark):
    grid = Grid(2, 3)
    quads = [(16 * k, 1) for k in range(4)]

    def check(rows, message):
        with pytest.raises(InvalidTree, match=message):
            verify(spark.createDataFrame(rows, "code bigint, level int"), grid)

    check([], "empty")
    check(quads[:3], "sum to 1")
    check([*quads, (16, 2)], "overlap")
    check([*quads, quads[0]], "overlap")
    check([(1, 1), *quads[1:]], "aligned")
    check([*quads[:3], (64, 1)], "outside")
    check([*quads[:3], (48, 4)], "out of range")


def test_points_tree_against_brute_force(spark):
    """A third of the points in one spot, and points that lie nowhere."""
    grid, capacity = Grid(2, 5), 3
    points = [((i * 7) % 32, (i * i) % 32) for i in range(200)] + [(9, 9)] * 100
    outside = [(None, 4), (3, None), (-1, 2), (2, 32), (17, -15), (1 << 40, 0)]
    rows = spark.createDataFrame([*points, *outside], "x bigint, y bigint")
    assert sorted(map(repr, rejected_points(rows, grid).collect())) == sorted(map(repr, spark.createDataFrame(outside, rows.schema).collect()))
    for row in outside:
        with pytest.raises(Exception, match="point outside the grid"):
            encode_points(spark.createDataFrame([row], rows.schema), grid).collect()
    df = encode_points(rows, grid, reject=True)
    got = {tuple(r) for r in T.cell_columns(tree_of_points(df, grid, capacity), grid)
           .select("level", "x", "y").collect()}
    want = set()

    def visit(level, x, y):
        size = 32 >> level
        inside = sum(x <= px < x + size and y <= py < y + size for px, py in points)
        if level < 5 and inside > capacity:
            for k in range(4):
                visit(level + 1, x + (k & 1) * size // 2, y + (k >> 1) * size // 2)
        else:
            want.add((level, x, y))

    visit(0, 0, 0)
    assert got == want


def test_fine_level_belongs_to_the_predicate(spark):
    """What an oracle leaves unsplit at its fine level, no further pass would split."""
    grid, oracle = Grid(2, 4), O.when("level < 3", fine_level=2)
    leaves = T.refine_converge(T.root(spark), grid, oracle)
    assert leaves.count() == 16 and not T.refine_changes(leaves, grid, oracle)
    assert T.refine_converge(T.root(spark), grid, O.when("level < 3")).count() == 64


LEVEL_ONE = [(64 * k, 1) for k in range(4)]


def errors(spark, values, cells=None):
    cells = cells or LEVEL_ONE
    return spark.createDataFrame([(c, lv, float(e)) for (c, lv), e in zip(cells, values)],
                                 "code bigint, level int, error double")


def test_scalar_field(spark):
    grid = Grid(2, 4)
    leaves = spark.createDataFrame(LEVEL_ONE, "code bigint, level int")
    f = scalar_field(errors(spark, (10, 1, 1, 1)), grid, 0.5, 0.0, 0, 4)
    assert f.refine_converge(leaves).count() == 7
    assert scalar_field(errors(spark, (10, 1, 1, 1)), grid, 1.0, 0.0, 0, 4).refine(leaves).count() == 16
    zero = scalar_field(errors(spark, (0, 0, 0, 0)), grid, 0.5, 0.0, 0, 4)
    assert zero.refine_cutoff == math.inf and zero.refine(leaves).count() == 4
    base = scalar_field(errors(spark, (0, 0, 0, 0)), grid, 0.5, 0.0, 3, 4)
    assert base.refine_converge(leaves).agg(F.min("level")).first()[0] == 3
    seven = [(16 * k, 2) for k in range(4)] + LEVEL_ONE[1:]
    tree = spark.createDataFrame(seven, "code bigint, level int")
    f = scalar_field(errors(spark, (1, 1, 1, 1, 10, 10, 10), seven), grid, 0.5, 0.01 + 4 / 304, 0, 4)
    assert f.coarsen(tree).count() == 4
    f = scalar_field(errors(spark, (100, 1, 1, 1)), grid, 0.3, 0.1, 0, 4)
    assert f.coarsen(leaves).count() == 4 and f.refine(leaves).count() == 7
    for bad in (dict(theta_refine=1.5), dict(theta_refine=math.nan), dict(coarse_level=5)):
        args = dict(theta_refine=0.5, theta_coarsen=0.1, coarse_level=0, fine_level=4) | bad
        with pytest.raises(ValueError):
            scalar_field(errors(spark, (1, 1, 1, 1)), grid, **args)
    with pytest.raises(ValueError):
        scalar_field(errors(spark, (-1, 1, 1, 1)), grid, 0.5, 0.1, 0, 4)
