"""Codes and neighbours against a plain decode-move-encode in Python."""

import random
from itertools import product

import pytest

from quadrille import Grid
from quadrille.functions import morton as M
from quadrille.grid import max_level_limit


def encode(coords):
    return sum(((c >> i) & 1) << (len(coords) * i + a) for a, c in enumerate(coords) for i in range(32))


@pytest.mark.parametrize("dim,bits", [(2, 31), (3, 21), (2, 5), (3, 1)])
def test_round_trip(spark, dim, bits):
    rng = random.Random(dim * bits)
    points = [tuple(rng.randrange(1 << bits) for _ in range(dim)) for _ in range(500)]
    points += [(0,) * dim, ((1 << bits) - 1,) * dim]
    axes = "xyz"[:dim]
    df = spark.createDataFrame(points, ", ".join(f"{a} bigint" for a in axes))
    out = df.selectExpr(*axes, f"{M.encode(list(axes), bits)} AS code") \
        .selectExpr("*", *[f"{e} AS d{a}" for a, e in zip(axes, M.decode("code", dim, bits))]).collect()
    for r in out:
        p = tuple(r[a] for a in axes)
        assert r["code"] == encode(p)
        assert tuple(r["d" + a] for a in axes) == p


@pytest.mark.parametrize("dim,max_level,n", [(2, 3, 0), (3, 2, 0), (2, 31, 150), (3, 21, 80)])
def test_neighbours(spark, dim, max_level, n):
    grid = Grid(dim, max_level)
    rng = random.Random(max_level)
    if n:  # deep grids: random cells, many of them at the boundary
        edge = [0, 1, grid.width - 1, grid.width - 2]
        cells = [(tuple(rng.choice([*edge, rng.randrange(grid.width)]) for _ in range(dim)), max_level)
                 for _ in range(n)]
    else:
        cells = [(p, lv) for lv in range(max_level + 1)
                 for p in product(range(0, grid.width, 1 << (max_level - lv)), repeat=dim)]
    df = spark.createDataFrame([(encode(p), lv, *p) for p, lv in cells],
                               "code bigint, level int, " + ", ".join(f"{a} bigint" for a in grid.axes))
    directions = [d for d in product((-1, 0, 1), repeat=dim)]
    rows = df.select("*").selectExpr("*", *[f"{M.neighbour('code', 'level', d, grid)} AS n{i}"
                                            for i, d in enumerate(directions)]).collect()
    for r in rows:
        size = 1 << (max_level - r["level"])
        for i, d in enumerate(directions):
            q = [r[a] + k * size for a, k in zip(grid.axes, d)]
            inside = all(0 <= c < grid.width for c in q)
            assert r[f"n{i}"] == (encode(q) if inside else None), (r, d)


def test_no_neighbour_for_bad_levels(spark):
    grid = Grid(2, 3)
    row = spark.sql("SELECT 0L AS code").selectExpr(
        *[f"{M.neighbour('code', lv, (1, 0), grid)} AS n{i}" for i, lv in enumerate(("4", "-1", "0"))]).first()
    assert list(row) == [None, None, None]


def test_limits():
    assert max_level_limit(2) == 31 and max_level_limit(3) == 21
    for dim, level in ((2, 32), (3, 22), (2, -1), (4, 3)):
        with pytest.raises(ValueError):
            Grid(dim, level)
