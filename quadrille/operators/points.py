"""Trees that follow data: cells split where points are dense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.morton import ancestor, encode
from quadrille.grid import Grid
from quadrille.operators.tree import leaves_of, with_corner
from quadrille.plans.staging import stage


def _inside(grid: Grid) -> str:
    """Condition that all coordinates are known and lie in the domain."""
    return " AND ".join(f"coalesce({a} BETWEEN 0 AND {(1 << grid.max_level) - 1}, false)" for a in grid.axes)


def rejected_points(points: DataFrame, grid: Grid) -> DataFrame:
    """The points that no cell of ``grid`` holds: a coordinate is NULL or outside the domain."""
    return points.filter(f"NOT ({_inside(grid)})")


def encode_points(points: DataFrame, grid: Grid, reject: bool = False) -> DataFrame:
    """Add the ``code`` of the deepest cell that holds each point.

    A point outside the domain ends the query with an error, unless ``reject`` is set: then such points are left out
    here and are what :func:`rejected_points` returns.  The code is never NULL, which keeps Catalyst from repeating the
    whole encoding in the null filters of later joins.
    """
    code = encode(list(grid.axes), max(grid.max_level, 1))
    if reject:
        return points.filter(_inside(grid)).withColumn("code", F.expr(f"coalesce({code}, -1L)"))
    told = ", ', ', ".join(f"coalesce(CAST({a} AS STRING), 'NULL')" for a in grid.axes)
    fail = f"raise_error(concat('point outside the grid of level {grid.max_level}: ', {told}))"
    return points.withColumn("code", F.expr(f"coalesce(CASE WHEN {_inside(grid)} THEN {code} ELSE CAST({fail} AS BIGINT) END, -1L)"))


def crowded_cells(points: DataFrame, grid: Grid, capacity: int) -> DataFrame:
    """Cells above the deepest level that hold more than ``capacity`` points.

    Points first collapse to counts per deepest cell, combined map-side, so a
    spot with very many copies becomes one row; counts are then summed over
    all ancestors in one more aggregation.
    """
    cells = points.groupBy("code").agg(F.count(F.lit(1)).alias("points"))
    if grid.max_level == 0:
        return cells.selectExpr("code", "0 AS level", "points").filter("false")
    up = cells.selectExpr("code AS c", "points", f"explode(sequence(0, {grid.max_level - 1})) AS level")
    return up.selectExpr(f"{ancestor('c', 'level', grid)} AS code", "level", "points") \
        .groupBy("code", "level").agg(F.sum("points").alias("points")) \
        .filter(F.col("points") > capacity)


def tree_of_points(points: DataFrame, grid: Grid, capacity: int) -> DataFrame:
    """Coarsest tree whose leaves hold at most ``capacity`` points (or are deepest).

    The same tree as refining the root while a cell is crowded: a crowded cell's
    ancestors are crowded, so the crowded cells are exactly the split ones.
    """
    return leaves_of(crowded_cells(points, grid, capacity).select("code", "level"), grid)


#: Cells of a level that may be broadcast, a bound that the geometry gives.
_FEW_CELLS = 1 << 15


def splits_by_measure(points: DataFrame, grid: Grid, measures: dict[str, tuple[str, str]], rule: str,
                      fine_level: int | None = None) -> DataFrame:
    """Cells ``(code, level)`` that split because of the points in them, from the root down.

    ``measures`` names what is known of a cell: ``{"total": ("sum", "value")}`` is the sum of ``value`` over its points; ``min``
    and ``max`` are the other kinds.  ``rule`` is SQL over these, the cell's ``code``, ``level``, corner and ``size``.  A cell
    is looked at only if the one above it split, and an empty one never is.

    Points collapse to one row for each deepest cell first.  Each pass sums up the rows below the cells of the last pass, with
    partial sums before the shuffle, and only rows below cells that split go on to the next; so no row is listed for more
    levels than its leaf is deep, and a crowded place is a row from the start.
    """
    if any(kind not in ("sum", "min", "max") for kind, _ in measures.values()):
        raise ValueError("a measure is a sum, min or max")
    rows = points.groupBy("code").agg(*[F.expr(f"{kind}({value}) AS {name}") for name, (kind, value) in measures.items()])
    rows = stage(rows.withColumnRenamed("code", "deep"), "measures")
    found: DataFrame | None = None
    for level in range(grid.max_level if fine_level is None else min(fine_level, grid.max_level)):
        cell = f"{ancestor('deep', str(level), grid)} AS code"
        sums = rows.selectExpr("*", cell).groupBy("code").agg(*[F.expr(f"{kind}({name}) AS {name}") for name, (kind, _) in measures.items()])
        split = with_corner(sums.withColumn("level", F.lit(level)), grid).filter(f"coalesce({rule}, false)").select("code", "level")
        split = stage(split, "split")
        if split.isEmpty():
            break
        found = split if found is None else found.unionByName(split)
        inside = split.select("code")
        inside = F.broadcast(inside) if grid.children ** level <= _FEW_CELLS else inside
        rows = stage(rows.selectExpr("*", cell).join(inside, "code", "left_semi").drop("code"), "measures")
    return found if found is not None else points.selectExpr("code", "0 AS level").filter("false")


def tree_of_measures(points: DataFrame, grid: Grid, measures: dict[str, tuple[str, str]], rule: str, fine_level: int | None = None) -> DataFrame:
    """The tree that :func:`splits_by_measure` gives: refining the root until no cell's points ask for more."""
    return leaves_of(splits_by_measure(points, grid, measures, rule, fine_level), grid)
