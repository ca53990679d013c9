import random
import re

from pyspark.sql import functions as F

from quadrille import Grid
from quadrille.operators import locate as L
from quadrille.operators import partitions as X
from quadrille.operators import tree as T
from quadrille.plans import intervals as I


def brute(rows, marks):
    return sorted((c, p, max((m for k, m in marks if k <= c), default=None)) for c, p in rows)


def test_running_max_against_brute_force(spark):
    draw = random.Random(4)
    for top in (20, 10_000):
        rows = [(draw.randrange(top), k) for k in range(600)] + [(7, 1000 + k) for k in range(900)]  # one code with most rows
        marks = [(draw.randrange(top), draw.randrange(50)) for _ in range(40)]
        expected = brute(rows, marks)
        for parts in (1, 2, 9, 64):
            df = I.running_max(spark.createDataFrame(rows, "code long, pid long"), spark.createDataFrame(marks, "code long, mark long"), parts)
            assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == sorted(expected, key=lambda r: r[:2])
    none = spark.createDataFrame([], "code long, mark long")
    assert {r["mark"] for r in I.running_max(spark.createDataFrame(rows, "code long, pid long"), none).collect()} == {None}
    assert I.running_max(none.selectExpr("code", "mark AS pid"), none).count() == 0


def test_a_heavy_code_is_dealt_over_parts(spark):
    rows = spark.range(40_000).selectExpr("IF(id % 3 = 0, 5L, id) AS code", "id AS pid")
    marks = spark.createDataFrame([(0, 1), (5, 2), (30_000, 3)], "code long, mark long")
    found = I.running_max(rows, marks, 12)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text
    parts = found._jdf.queryExecution().toRdd()  # the plan runs
    assert parts is not None
    cuts = I.cut_points(rows.select("code"), 12)
    assert cuts.count(5) >= 3
    assert {(r["mark"], r["count"]) for r in found.groupBy("mark").count().collect()} == {
        (1, rows.filter("code < 5").count()), (2, rows.filter("code >= 5 AND code < 30000").count()), (3, rows.filter("code >= 30000").count())}


def test_no_row_is_multiplied_and_each_side_is_shuffled_once(spark):
    grid = Grid(2, 12)
    leaves = T.root(spark)
    for flag in ("true", "true", "code % 7 = 0", "code % 5 = 0", "code % 3 = 0"):
        leaves = T.split_flagged(leaves, grid, flag)
    leaves = spark.createDataFrame(leaves.collect(), leaves.schema)
    points = spark.range(5000).selectExpr("id AS pid", "pmod(xxhash64(id), 16777216L) AS code")
    located = L.locate(points, leaves, grid)
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Python" not in plan and "Arrow" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(_part", plan)) <= 2  # rows with marks, and a row for each part
    assert located.count() == 5000
    ends = {r["code"]: r["level"] for r in leaves.collect()}
    for r in located.collect():
        size = 1 << (2 * (12 - r["leaf_level"]))
        assert r["leaf_code"] <= r["code"] < r["leaf_code"] + size and ends[r["leaf_code"]] == r["leaf_level"]


def test_covered_by_regions_is_the_range_join(spark):
    grid = Grid(2, 6)
    leaves = T.root(spark)
    for flag in ("true", "code < 2048", "code % 128 < 64", "code % 3 = 0"):
        leaves = T.split_flagged(leaves, grid, flag)
    leaves = spark.createDataFrame(leaves.collect(), leaves.schema)
    picked = leaves.filter("code % 5 = 0")
    regions = [(r["n_code"], r["n_code"] + (1 << (2 * (6 - r["level"])))) for r in L.neighbour_cells(picked, grid).collect()]
    expected = {(r["code"], r["level"]) for r in leaves.collect()
                if any(a <= r["code"] and r["code"] + (1 << (2 * (6 - r["level"]))) <= b for a, b in regions)}
    assert {tuple(r) for r in L.covered_by_regions(picked, leaves, grid).collect()} == expected


def test_internal_cells_are_the_ancestors(spark):
    grid = Grid(3, 5)
    leaves = T.root(spark)
    for flag in ("true", "code % 1024 = 0", "code % 3 = 0"):
        leaves = T.split_flagged(leaves, grid, flag)
    expected = {(r["code"] >> (3 * (5 - k)) << (3 * (5 - k)), k) for r in leaves.collect() for k in range(r["level"])}
    found = T.internal_of(leaves, grid)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert T.internal_of(T.root(spark), grid).agg(F.count("*")).first()[0] == 0


def test_ghosts_against_brute_force_and_without_broadcasts_of_leaves(spark):
    from quadrille.functions.morton import last_code

    grid, draw = Grid(2, 5), random.Random(12)
    cells = [(0, 0)]
    for _ in range(60):  # split some leaf, most often a deep one
        code, level = cells.pop(max(draw.randrange(len(cells)) for _ in range(2)))
        step = 1 << 2 * (grid.max_level - level - 1) if level < grid.max_level else 0
        cells += [(code + k * step, level + 1) for k in range(4)] if step else [(code, level)]
    cells.sort()
    every = spark.createDataFrame(cells, "code long, level int")
    near = L.neighbour_cells(every, grid).selectExpr("code", "n_code", f"{last_code('n_code', 'level', grid)} AS n_last").collect()
    ends = {(r[0], r[1]): r[2] for r in every.selectExpr("code", "level", f"{last_code('code', 'level', grid)} AS last").collect()}
    for owner in ([k * 5 // len(cells) for k in range(len(cells))], [draw.randrange(3) for _ in cells]):  # runs, and no runs
        own = {cell: part for cell, part in zip(cells, owner)}
        part_at = {c: own[c, lv] for c, lv in cells}
        expected = {(part_at[r["code"]], c, lv, own[c, lv]) for r in near for c, lv in cells
                    if c <= r["n_last"] and ends[c, lv] >= r["n_code"] and own[c, lv] != part_at[r["code"]]}
        assigned = spark.createDataFrame([(c, lv, own[c, lv]) for c, lv in cells], "code long, level int, part int")
        found = X.ghost_layer(assigned, grid)
        assert sorted(map(tuple, found.collect())) == sorted(expected) and expected
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("BroadcastHashJoin") == 1  # the sweep's, with a row for each of its parts
