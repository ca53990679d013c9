"""Joins between cells: which leaf covers a point, which leaves lie in a region.

A containment join is turned into an equi-join on ``(code, level)``: a point's
ancestors are the only cells that can cover it.  A directory of at most a few
tens of thousands of coarse cells, each with the set of leaf levels below it,
tells which of the ancestors are worth trying, usually one or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.morton import ancestor, below, last_code, neighbour
from quadrille.grid import Grid
from quadrille.plans.intervals import running_max

# Directory depth; at most 2**(dim * depth) rows, so always small enough to broadcast.
_DIRECTORY_LEVEL = {2: 7, 3: 5}


def level_directory(leaves: DataFrame, grid: Grid) -> DataFrame:
    """``(slot, levels)``: the leaf levels present in each coarse cell."""
    depth = min(_DIRECTORY_LEVEL[grid.dim], grid.max_level)
    first = f"shiftright(code, {below(depth, grid)})"
    spare = f"~shiftleft(-1L, greatest({depth} - level, 0) * {grid.dim})"
    return leaves.selectExpr("level", f"explode(sequence({first}, {first} | ({spare}))) AS slot") \
        .groupBy("slot").agg(F.collect_set("level").alias("levels"))


def candidates(points: DataFrame, leaves: DataFrame, grid: Grid) -> DataFrame:
    """Points with each cell ``(leaf_code, leaf_level)`` that may be their leaf."""
    depth = min(_DIRECTORY_LEVEL[grid.dim], grid.max_level)
    directory = F.broadcast(level_directory(leaves, grid))
    tried = points.withColumn("slot", F.expr(f"shiftright(code, {below(depth, grid)})")) \
        .join(directory, "slot")
    return tried.selectExpr(*points.columns, "explode(levels) AS leaf_level") \
        .withColumn("leaf_code", F.expr(ancestor("code", "leaf_level", grid)))


def locate(points: DataFrame, leaves: DataFrame, grid: Grid) -> DataFrame:
    """Add ``leaf_code, leaf_level`` of the leaf that covers each point's ``code``.

    Leaves are disjoint, so the only one that can is the last to begin at or before the point: one sweep in code order.
    """
    marks = leaves.selectExpr("code", "named_struct('code', code, 'level', level) AS mark")
    return running_max(points, marks).filter(f"code <= {last_code('mark.code', 'mark.level', grid)}").select(
        *points.columns, F.col("mark.code").alias("leaf_code"), F.col("mark.level").alias("leaf_level"))


def aggregate_by_leaf(points: DataFrame, leaves: DataFrame, grid: Grid,
                      *aggregates: Column) -> DataFrame:
    """Aggregate points per covering leaf; leaves without points do not appear.

    Points are aggregated on their candidate cells before the join, so a leaf
    with very many points is reduced map-side and both sides of the join are
    already partitioned by cell.
    """
    cells = leaves.selectExpr("code AS leaf_code", "level AS leaf_level")
    grouped = candidates(points, leaves, grid).groupBy("leaf_code", "leaf_level").agg(*aggregates)
    return grouped.join(cells, ["leaf_code", "leaf_level"], "left_semi")


def neighbour_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """Same-size neighbours: ``code, level, dir, n_code`` (``dir`` indexes the stencil)."""
    each = ", ".join(neighbour("code", "level", d, grid) for d in grid.stencil)
    return cells.selectExpr("code", "level", f"posexplode(array({each})) AS (dir, n_code)") \
        .filter("n_code IS NOT NULL")


def covered_by_regions(cells: DataFrame, leaves: DataFrame, grid: Grid) -> DataFrame:
    """Leaves inside the same-size neighbour region of any of ``cells``.

    Regions are nested or disjoint, so a leaf lies in one exactly if, of those that begin at or before it, the one that
    reaches furthest reaches its end: one sweep in code order.  Regions are deduplicated first and no pairs are formed.
    """
    regions = neighbour_cells(cells, grid).selectExpr("n_code AS code", "level").distinct().selectExpr(
        "code", f"{last_code('code', 'level', grid)} AS mark")
    return running_max(leaves.select("code", "level"), regions).filter(f"mark >= {last_code('code', 'level', grid)}").select("code", "level")


def neighbour_levels(leaves: DataFrame, grid: Grid) -> DataFrame:
    """Deepest leaf level met in each leaf's neighbour regions: ``code, level, dir, max_level``.

    A region is either subdivided (its depth is the deepest leaf below it), a
    leaf, or part of a coarser leaf.
    """
    up = leaves.selectExpr("code AS c", "level AS deep", "explode(sequence(0, level)) AS level")
    depth = up.selectExpr(f"{ancestor('c', 'level', grid)} AS n_code", "level", "deep") \
        .groupBy("n_code", "level").agg(F.max("deep").alias("deep"))
    asked = neighbour_cells(leaves, grid)
    found = asked.join(depth, ["n_code", "level"], "left")
    coarser = found.filter("deep IS NULL").selectExpr(
        "code", "level", "dir", "n_code", "explode(sequence(0, level)) AS l_level") \
        .withColumn("l_code", F.expr(ancestor("n_code", "l_level", grid)))
    cover = coarser.join(leaves.selectExpr("code AS l_code", "level AS l_level"),
                         ["l_code", "l_level"]).selectExpr("code", "level", "dir", "l_level AS deep")
    return found.filter("deep IS NOT NULL").select("code", "level", "dir", "deep").unionByName(cover) \
        .withColumnRenamed("deep", "max_level")
