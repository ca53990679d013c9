"""Linear trees: leaves as a relation ``(code BIGINT, level INT)``.

Refinement is a chain of row expansions.  Nothing in it needs a shuffle; the
only exchanges are the ones that spread freshly created cells over the cluster,
so that one heavily refined corner cannot stay in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.morton import (
    ancestor, child, child_bit, corner, last_code, size, volume,
)
from quadrille.grid import Grid
from quadrille.operators.oracles import Oracle
from quadrille.plans.staging import width


def root(spark: SparkSession) -> DataFrame:
    """The tree of one leaf."""
    return spark.range(1).selectExpr("0L AS code", "0 AS level")


def with_corner(cells: DataFrame, grid: Grid) -> DataFrame:
    """Add each cell's corner coordinates and its size."""
    coords = [f"{c} AS {a}" for a, c in zip(grid.axes, corner("code", grid))]
    return cells.selectExpr("*", *coords, f"{size('level', grid)} AS size")


def _split(cells: DataFrame, grid: Grid, flag: Column | str, coords: bool) -> DataFrame:
    """Replace flagged rows by their children, marked open; other rows are closed."""
    def struct(code: str, level: str, at: list[str], edge: str, is_open: str) -> str:
        geometry = "".join(f", '{a}', {v}" for a, v in zip(grid.axes, at)) + f", 'size', {edge}" \
            if coords else ""
        return f"named_struct('code', {code}, 'level', {level}{geometry}, 'open', {is_open})"

    half = "shiftright(size, 1)"
    kids = ", ".join(
        struct(child("code", "level", k, grid), "level + 1",
               [f"{a} + {half}" if k >> i & 1 else a for i, a in enumerate(grid.axes)], half, "true")
        for k in range(grid.children))
    keep = struct("code", "level", list(grid.axes), "size", "false")
    flag = F.expr(flag) if isinstance(flag, str) else flag
    return cells.withColumn("_split", flag).selectExpr(
        f"inline(IF(_split AND level < {grid.max_level}, array({kids}), array({keep})))")


def split_flagged(leaves: DataFrame, grid: Grid, flag: Column | str) -> DataFrame:
    """Split the leaves for which ``flag`` holds, one level."""
    return _split(leaves, grid, flag, coords=False).select("code", "level")


def _cells(leaves: DataFrame, grid: Grid, oracle: Oracle) -> DataFrame:
    cells = leaves.select("code", "level")
    return with_corner(cells, grid) if oracle.coords else cells


def refine(leaves: DataFrame, grid: Grid, oracle: Oracle) -> DataFrame:
    """One refinement pass over all leaves."""
    return _split(_cells(leaves, grid, oracle), grid, oracle.splits(grid), oracle.coords) \
        .select("code", "level")


def refine_changes(leaves: DataFrame, grid: Grid, oracle: Oracle) -> bool:
    """Whether a refinement pass would split anything."""
    cells = _cells(leaves, grid, oracle).filter(f"level < {grid.max_level}")
    return not cells.filter(oracle.splits(grid)).isEmpty()


def refine_converge(leaves: DataFrame, grid: Grid, oracle: Oracle,
                    from_level: int = 0, passes: int | None = None) -> DataFrame:
    """Refine until nothing splits (or for ``passes`` passes).

    An oracle depends on the cell alone, so a leaf it declined stays a leaf:
    only cells created by the previous pass are tested again.  The passes are
    one narrow pipeline; every few levels the cells are spread again by hash.
    """
    rounds = max(oracle.fine(grid) - from_level, 0)
    if passes is not None:
        rounds = min(rounds, passes)
    spread_every = 4 if grid.dim == 2 else 3
    cells = _cells(leaves, grid, oracle).withColumn("open", F.lit(True))
    flag = F.col("open") & oracle.splits(grid)
    for i in range(rounds):
        if i % spread_every == spread_every - 1 and rounds - i > 1:
            cells = cells.repartition(width(leaves.sparkSession), "code", "level")
        cells = _split(cells, grid, flag, oracle.coords)
    return cells.select("code", "level")


def leaves_of(internal: DataFrame, grid: Grid) -> DataFrame:
    """Leaves of the tree whose split cells are ``internal(code, level)``.

    Each split cell reports itself and marks its bit in its parent; one
    aggregation gives every split cell the set of its split children, and the
    other children are the leaves.  The virtual cell above the root stands for
    the unrefined tree.
    """
    above = internal.sparkSession.range(1).selectExpr("0L AS code", "-1 AS level", "0 AS mask")
    up = ancestor("code", "greatest(level - 1, 0)", grid)
    rows = internal.selectExpr(
        "inline(array(named_struct('code', code, 'level', level, 'mask', 0),"
        f" named_struct('code', {up}, 'level', level - 1,"
        f" 'mask', IF(level > 0, {child_bit('code', 'level', grid)}, 1))))")
    masks = rows.unionByName(above).groupBy("code", "level").agg(F.bit_or("mask").alias("mask"))
    return expand_masks(masks, grid)


def expand_masks(masks: DataFrame, grid: Grid) -> DataFrame:
    """Children of ``(code, level, mask)`` whose bit is not set in ``mask``."""
    kids = ", ".join(
        f"IF((mask & {1 << k}) = 0, named_struct('code', "
        f"{child('code', 'level', k, grid)}, 'level', level + 1), NULL)"
        for k in range(grid.children))
    only_root = "array(IF(mask = 0, named_struct('code', 0L, 'level', 0), NULL))"
    return masks.selectExpr(f"explode(IF(level < 0, {only_root}, array({kids}))) AS c") \
        .filter("c IS NOT NULL").selectExpr("c.code AS code", "c.level AS level")


def parents_of(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Distinct parents of the leaves."""
    return leaves.filter("level > 0").selectExpr(
        f"{ancestor('code', 'level - 1', grid)} AS code", "level - 1 AS level").distinct()


def internal_of(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Every split cell of the tree, i.e. every proper ancestor of a leaf.

    The leaves tile the domain, so exactly one of those below a cell begins where the cell does: each leaf lists the
    ancestors that begin with it, and nothing is shuffled.
    """
    each = leaves.filter("level > 0").selectExpr("code", "explode(sequence(0, level - 1)) AS level")
    return each.filter(f"{ancestor('code', 'level', grid)} = code").select("code", "level")


def families(leaves: DataFrame, grid: Grid, *extra: Column) -> DataFrame:
    """Parents with the set of their leaf children as a bit mask.

    A tree of one leaf counts as an incomplete family above the root.
    """
    rows = leaves.selectExpr(
        "*", f"{child_bit('code', 'level', grid)} AS bit",
        f"{ancestor('code', 'level - 1', grid)} AS parent")
    return rows.groupBy(F.col("parent").alias("code"), (F.col("level") - 1).alias("level")) \
        .agg(F.bit_or("bit").alias("mask"), *extra)


def emit_families(groups: DataFrame, grid: Grid, merged: Column | str) -> DataFrame:
    """Parents of merged families, leaves of the others."""
    kids = ", ".join(
        f"IF((mask & {1 << k}) <> 0, named_struct('code', "
        f"{child('code', 'level', k, grid)}, 'level', level + 1), NULL)"
        for k in range(grid.children))
    merged = F.expr(merged) if isinstance(merged, str) else merged
    return groups.withColumn("_merged", merged).selectExpr(
        f"explode(IF(_merged, array(named_struct('code', code, 'level', level)), array({kids}))) AS c"
    ).filter("c IS NOT NULL").selectExpr("c.code AS code", "c.level AS level")


def coarsen(leaves: DataFrame, grid: Grid, keep: Oracle) -> DataFrame:
    """Merge complete families whose parent ``keep`` declines, one level.

    One aggregation per parent collects the set of its leaves; the same set
    restores the leaves of families that stay, so there is no join.
    """
    groups = families(leaves, grid)
    if keep.coords:
        groups = with_corner(groups, grid)
    merged = (F.col("mask") == grid.full_mask) & ~keep.splits(grid)
    return emit_families(groups, grid, merged)


def level_histogram(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("level").agg(F.count(F.lit(1)).alias("leaves"))


def summary(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Leaf count, level range and covered share of the domain, in one pass."""
    return leaves.selectExpr("count(1) AS leaves", "min(level) AS min_level",
                             "max(level) AS max_level", f"sum({volume('level', grid)}) AS volume")


def cell_columns(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Geometry of every leaf: corner, size, end of its code range and volume."""
    return with_corner(leaves, grid).selectExpr(
        "*", f"{last_code('code', 'level', grid)} AS last_code", f"{volume('level', grid)} AS volume")


def same_leaves(a: DataFrame, b: DataFrame) -> bool:
    """Whether two trees are equal, by one aggregation over both."""
    tagged = a.selectExpr("code", "level", "1 AS d").unionByName(
        b.selectExpr("code", "level", "-1 AS d"))
    return tagged.groupBy("code", "level").agg(F.sum("d").alias("d")).filter("d <> 0").isEmpty()
