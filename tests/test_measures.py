import random

import pytest

from quadrille import Grid
from quadrille.operators.points import splits_by_measure, tree_of_measures


def brute(points, grid, ask):
    """Cells from the root down of which ``ask(sum, largest, count, level)`` holds."""
    out, open_cells = set(), [(0, 0, points)]
    while open_cells:
        code, level, inside = open_cells.pop()
        values = [v for _, v in inside]
        if level < grid.max_level and inside and ask(sum(values), max(values), len(values), level):
            out.add((code, level))
            width = 1 << (grid.dim * (grid.max_level - level - 1))
            for k in range(grid.children):
                low = code + k * width
                open_cells.append((low, level + 1, [p for p in inside if low <= p[0] < low + width]))
    return out


@pytest.mark.parametrize("dim", [2, 3])
def test_splits_follow_sums_from_the_root_down(spark, dim):
    grid, draw = Grid(dim, 5), random.Random(dim)
    top = 1 << (dim * 5)
    points = [(draw.randrange(top), draw.randrange(-50, 50)) for _ in range(400)] + [(77, 1)] * 300
    df = spark.createDataFrame(points, "code long, v long")
    measures = {"total": ("sum", "v"), "top": ("max", "v"), "n": ("sum", "1")}
    found = {tuple(r) for r in splits_by_measure(df, grid, measures, "n > 3 AND (abs(total) > 20 OR top > 45 - level)").collect()}
    expected = brute(points, grid, lambda s, m, n, level: n > 3 and (abs(s) > 20 or m > 45 - level))
    assert found == expected and expected
    leaves = tree_of_measures(df, grid, measures, "n > 3 AND (abs(total) > 20 OR top > 45 - level)").collect()
    assert sum(1 << (dim * (5 - r["level"])) for r in leaves) == top and not {tuple(r) for r in leaves} & expected


def test_empty_table_and_refusals(spark):
    grid = Grid(2, 4)
    none = spark.createDataFrame([], "code long, v long")
    assert [tuple(r) for r in tree_of_measures(none, grid, {"n": ("sum", "1")}, "n > 0").collect()] == [(0, 0)]
    one = spark.createDataFrame([(3, 1)], "code long, v long")
    assert splits_by_measure(one, grid, {"n": ("sum", "1")}, "n > 0", fine_level=2).count() == 2
    assert splits_by_measure(one, grid, {"n": ("sum", "1")}, "NULL").count() == 0
    with pytest.raises(ValueError):
        splits_by_measure(one, grid, {"n": ("avg", "v")}, "n > 0")
