"""How a tree divides into equal runs of leaves, and what the runs share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.morton import ancestor, last_code, neighbour
from quadrille.grid import Grid
from quadrille.plans.intervals import running_max
from quadrille.plans.prefix import row_index
from quadrille.plans.staging import stage


def assign_parts(leaves: DataFrame, parts: int) -> DataFrame:
    """Add ``part``: runs of the code order whose sizes differ by at most one.

    Part ``r`` starts at row ``r * (n // parts) + min(r, n % parts)``; the
    first parts take the remainder.
    """
    indexed = row_index(leaves, ["code", "level"])
    n = F.broadcast(indexed.agg(F.count(F.lit(1)).alias("n")))
    quotient, rest = f"(n DIV {parts})", f"(n % {parts})"
    wide = f"({rest} * ({quotient} + 1))"
    part = (f"CAST(IF(row_index < {wide}, row_index DIV ({quotient} + 1), "
            f"{rest} + (row_index - {wide}) DIV greatest({quotient}, 1)) AS INT)")
    return indexed.crossJoin(n).selectExpr("code", "level", f"{part} AS part")


def repartition(leaves: DataFrame, parts: int) -> DataFrame:
    """Leaves physically divided in ``parts`` runs of the code order, sorted inside each."""
    return assign_parts(leaves, parts).repartitionById(parts, "part") \
        .sortWithinPartitions("code").drop("part")


def partition_map(assigned: DataFrame, parts: int) -> DataFrame:
    """First code of each part; an empty part takes the next one's, trailing ones NULL."""
    spark = assigned.sparkSession
    firsts = assigned.groupBy("part").agg(F.min("code").alias("first_code"),
                                          F.count(F.lit(1)).alias("leaves"))
    every = spark.range(parts).selectExpr("CAST(id AS INT) AS part")
    joined = every.join(F.broadcast(firsts), "part", "left")
    return joined.selectExpr(
        "part", "min(first_code) OVER (ORDER BY part ROWS BETWEEN CURRENT ROW AND "
        "UNBOUNDED FOLLOWING) AS first_code", "coalesce(leaves, 0L) AS leaves")


def ghost_layer(assigned: DataFrame, grid: Grid) -> DataFrame:
    """Leaves of other parts that each part sees in its neighbour regions.

    ``part`` is the part that needs the leaf ``(code, level)`` held by
    ``owner``: the leaf overlaps the same-size neighbour region of one of the
    part's leaves.  Regions are distinct per part before any join, and those
    amid their own part, where no other's leaf can be, are left out.  A leaf
    around a region matches on the region's ancestors.  One inside matches on
    its own; a sweep in code order first tells which leaves lie in any region.
    No side is broadcast: both grow with the tree.
    """
    each = ", ".join(neighbour("code", "level", d, grid) for d in grid.stencil)
    regions = assigned.selectExpr("part", "level AS r_level", f"explode(array({each})) AS r_code").filter("r_code IS NOT NULL").distinct()
    ranges = part_ranges(assigned, grid).selectExpr("part", "first_code", "last_code")  # one row for each part
    other = ranges.selectExpr("part AS other", "first_code AS other_first", "last_code AS other_last")
    runs = ranges.join(F.broadcast(other), F.expr("other <> part AND other_first <= last_code AND other_last >= first_code"), "left_anti")
    amid = f"r_code >= first_code AND {last_code('r_code', 'r_level', grid)} <= last_code"
    regions = stage(regions.join(F.broadcast(runs), "part", "left").filter(f"first_code IS NULL OR NOT ({amid})")
                    .select("part", "r_code", "r_level"), "regions")
    held = assigned.selectExpr("code", "level", "part AS owner")
    reach = regions.selectExpr("r_code AS code", f"{last_code('r_code', 'r_level', grid)} AS mark").distinct()
    seen = running_max(held, reach).filter(f"mark >= {last_code('code', 'level', grid)}")
    inside = seen.selectExpr("code", "level", "owner", "explode(sequence(0, level)) AS r_level").withColumn(
        "r_code", F.expr(ancestor("code", "r_level", grid)))
    around = regions.selectExpr("part", "r_code", "r_level",
                                "explode(sequence(0, r_level)) AS level").withColumn(
        "code", F.expr(ancestor("r_code", "level", grid))).select("part", "code", "level").distinct()
    columns = ["part", "code", "level", "owner"]
    found = regions.join(inside.hint("merge"), ["r_code", "r_level"]).select(*columns).unionByName(
        around.join(held.hint("merge"), ["code", "level"]).select(*columns))
    return found.filter("owner <> part").distinct()


def part_ranges(assigned: DataFrame, grid: Grid) -> DataFrame:
    """Code range and size of every part."""
    return assigned.withColumn("last", F.expr(last_code("code", "level", grid))).groupBy("part").agg(
        F.min("code").alias("first_code"), F.max("last").alias("last_code"),
        F.count(F.lit(1)).alias("leaves"))
