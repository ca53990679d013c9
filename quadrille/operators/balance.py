"""2:1 balance.

A leaf at level ``l`` asks that the level ``l - 2`` ancestor of each of its
stencil neighbours be split.  Three forms are offered:

``balance``         one descending sweep over levels (production form)
``balance_passes``  the pass-by-pass ripple, which also counts its passes
``violations``      an independent check by locating every neighbour
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.morton import ancestor, corner, encode, last_code, neighbour
from quadrille.grid import Grid
from quadrille.operators.tree import expand_masks, parents_of, split_flagged
from quadrille.plans.intervals import running_max
from quadrille.plans.staging import new_path, stage


def _stencil_cells(grid: Grid) -> list[list[str]]:
    """Cells one level up that a split cell asks to be split, as cell coordinates.

    Of a cell's stencil neighbours, those on the inner side of its family share
    its parent; only the outward ones can ask for another cell.
    """
    return [[f"shiftright({a}, 1) + {u} * (2 * ({a} & 1) - 1)" for a, u in zip(grid.axes, axes)]
            for axes in product((0, 1), repeat=grid.dim) if 1 <= sum(axes) <= grid.dim - 1]


def _region_cells(grid: Grid) -> list[list[str]]:
    """The stricter rule: every stencil neighbour of the parent."""
    return [[f"shiftright({a}, 1) + {d}" for a, d in zip(grid.axes, direction)]
            for direction in grid.stencil]


_RULES = {"stencil": _stencil_cells, "region": _region_cells}


def _asked(grid: Grid, rule: str, extra: str = "") -> str:
    """Rows a split cell sends up: its parent with its own bit, and the cells it asks for."""
    parent = [f"shiftright({a}, 1)" for a in grid.axes]
    bit = " | ".join(f"shiftleft({a} & 1, {k})" for k, a in enumerate(grid.axes))
    rows = [(parent, f"shiftleft(1, {bit})")] + [(c, "0") for c in _RULES[rule](grid)]
    return ", ".join(
        "named_struct('level', level - 1, "
        + ", ".join(f"'{a}', {v}" for a, v in zip(grid.axes, cell)) + f", 'mask', {mask}{extra})"
        for cell, mask in rows)


def _merge(rows: DataFrame, grid: Grid, *keys: str) -> DataFrame:
    """Drop cells outside the domain and combine the rest."""
    inside = " AND ".join(f"{a} BETWEEN 0 AND shiftleft(1, level) - 1" for a in grid.axes)
    return rows.filter(inside).groupBy("level", *grid.axes, *keys).agg(F.bit_or("mask").alias("mask"))


def _chain(rows: DataFrame, top: int, grid: Grid, rule: str) -> DataFrame:
    """Sweep ``rows`` from level ``top`` to the root as one plan.

    The level whose turn it is travels as a column, so every pass generates the
    same code and compiles once.
    """
    me = "named_struct('level', level, " + ", ".join(f"'{a}', {a}" for a in grid.axes) \
        + ", 'mask', mask, 'turn', turn - 1)"
    step = f"inline(IF(level = turn, array({me}, {_asked(grid, rule, ', \'turn\', turn - 1')}), array({me})))"
    rows = rows.withColumn("turn", F.lit(top))
    for _ in range(top):
        rows = _merge(rows.selectExpr(step), grid, "turn")
    return rows.drop("turn")


def balance(leaves: DataFrame, grid: Grid, rule: str = "stencil",
            chain_rows: int = 1 << 20) -> DataFrame:
    """Coarsest 2:1 balanced refinement of ``leaves``.

    From the deepest level up, the split cells of one level decide those of the
    level above: their parents, and the cells next to the parents that they
    touch.  One hash aggregation per level both removes duplicates and collects
    which children are split, so the leaves fall out without a join.  A level is
    a fraction of the one below it; the total work is proportional to the tree.

    ``rule="region"`` applies the stricter rule under which a cell also splits
    for deep cells of a neighbour region that do not touch it.

    Cells are held by their own coordinates during the sweep and encoded once at
    the end.  Levels are written one by one while what remains is large: the
    families of the levels left and the rows that the split cells just written
    ask for.  Once both together are at most ``chain_rows``, they are swept in
    one plan, which therefore never carries more than that.
    """
    spark = leaves.sparkSession
    coords = [f"CAST(shiftright({c}, {grid.max_level} - level) AS INT) AS {a}"
              for a, c in zip(grid.axes, corner("code", grid))]
    base = stage(parents_of(leaves, grid).selectExpr("level", *coords, "0 AS mask"), "families",
                 partition_by=["level"])
    sizes = {r["level"]: r["count"] for r in base.groupBy("level").count().collect()}
    if not sizes:  # nothing above any leaf: the tree is its root
        return leaves.select("code", "level")
    columns = ["level", *grid.axes, "mask"]
    schema = ", ".join(f"{c} INT" for c in [*grid.axes, "mask", "level"])
    path = new_path(spark, "splits")
    level, split, asked = max(sizes), None, 0
    while asked + sum(n for k, n in sizes.items() if k <= level) > chain_rows and level > 0:
        rows = base.filter(F.col("level") == level).select(*columns)
        if split is not None:
            rows = rows.unionByName(split.selectExpr(f"inline(array({_asked(grid, rule)}))"))
        _merge(rows, grid).write.mode("append").partitionBy("level").parquet(path)
        split = spark.read.schema(schema).parquet(path).filter(F.col("level") == level).select(*columns)
        asked = split.count() * (grid.dim * 3 - 2)  # rows a split cell sends up: at most 4, or 7 in 3D
        level -= 1
    rest = base.filter(F.col("level") <= level).select(*columns)
    if split is not None:
        rest = _merge(rest.unionByName(split.selectExpr(f"inline(array({_asked(grid, rule)}))")), grid)
    _chain(rest, level, grid, rule).write.mode("append").partitionBy("level").parquet(path)
    code = encode([f"shiftleft(CAST({a} AS BIGINT), {grid.max_level} - level)" for a in grid.axes],
                  max(grid.max_level, 1))
    splits = spark.read.schema(schema).parquet(path).selectExpr(f"{code} AS code", "level", "mask")
    return expand_masks(splits, grid)


def requirements(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Cells ``(code, level)`` the given leaves need split, with how many ask."""
    cells = ", ".join(neighbour("code", "level", d, grid) for d in grid.stencil)
    asked = leaves.filter("level >= 2").selectExpr(f"explode(array({cells})) AS n",
                                                   "level - 2 AS level").filter("n IS NOT NULL")
    return asked.selectExpr(f"{ancestor('n', 'level', grid)} AS code", "level") \
        .groupBy("code", "level").agg(F.count(F.lit(1)).alias("asking"))


def _too_coarse(needs: DataFrame, leaves: DataFrame, grid: Grid) -> DataFrame:
    """Each need with the leaf ``(code, level)`` that covers it whole.

    Leaves are disjoint, so that is the last one to begin at or before the need, if it reaches its end.
    """
    marks = leaves.selectExpr("code", "named_struct('code', code, 'level', level) AS mark")
    found = running_max(needs.select("code", "level", "asking"), marks)
    return found.filter(f"{last_code('mark.code', 'mark.level', grid)} >= {last_code('code', 'level', grid)}").selectExpr(
        "code AS need", "level AS need_level", "asking", "mark.code AS code", "mark.level AS level")


def violations(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Leaves too coarse for a neighbour: ``(code, level, violations)``.

    The count is of (leaf, direction) pairs whose neighbour is covered by a leaf more than one level coarser; equal needs
    are merged before they are located, by one sweep in code order.
    """
    needs = stage(requirements(leaves, grid), "needs")
    return _too_coarse(needs, leaves, grid).groupBy("code", "level").agg(F.sum("asking").alias("violations"))


@dataclass(frozen=True)
class Balanced:
    leaves: DataFrame
    passes: int


def balance_passes(leaves: DataFrame, grid: Grid) -> Balanced:
    """Ripple balance, pass by pass, with the number of passes that split leaves.

    Only needs that are not met yet and needs of new leaves are looked at in
    the next pass.  The input tree is not rewritten: the cells split so far are
    kept apart and applied once at the end.
    """
    base = leaves.select("code", "level")
    needs = stage(requirements(base, grid), "needs")
    every: DataFrame | None = None
    passes = 0
    while True:
        current = base
        if every is not None:
            current = current.unionByName(split_flagged(every, grid, "true")).join(every, ["code", "level"], "left_anti")
        hits = _too_coarse(needs, current, grid)
        hits = stage(hits.select("code", "level", "need", "need_level", "asking"), "ripple")
        if hits.isEmpty():
            break
        passes += 1
        split = hits.select("code", "level").distinct()
        unmet = hits.filter("need_level > level").select(
            F.col("need").alias("code"), F.col("need_level").alias("level"), "asking")
        needs = stage(unmet.unionByName(requirements(split_flagged(split, grid, "true"), grid)), "needs")
        every = split if every is None else stage(every.unionByName(split), "ripple")
    if every is None:
        return Balanced(base, 0)
    result = base.unionByName(split_flagged(every, grid, "true")) \
        .join(every, ["code", "level"], "left_anti")
    return Balanced(result, passes)
