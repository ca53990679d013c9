"""Joins of rows with nested or disjoint intervals, by one sweep in code order.

Rows and intervals are dealt into parts of the code order, together, and each part is swept once: a row meets the greatest mark
among the intervals that begin at or before it.  What begins in an earlier part comes in as one row a part.  So each side is
shuffled once and as it is; no row is multiplied by the levels it may be covered at.

Parts are cut at quantiles of both sides.  A code that fills several parts is dealt over all of them by a hash of its rows, so a
place with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.plans.staging import width


def cut_points(codes: DataFrame, parts: int) -> list[int]:
    """``parts - 1`` quantiles of the column ``code``, ascending; heavy codes stand several times."""
    shares = [k / parts for k in range(1, parts)]
    if not shares:
        return []
    found = codes.agg(F.percentile_approx("code", shares, max(10_000, 20 * parts))).first()[0]
    return sorted(found or [])


def _at_most(cuts: Column, n: int, code: Column) -> Column:
    """How many of the ``n`` ascending ``cuts`` are at most ``code``: a binary search without a row per cut."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step <= n) & (F.get(cuts, low + step - 1) <= code), low + step).otherwise(low))


def running_max(rows: DataFrame, marks: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` (code, ...) with ``mark``: the greatest ``mark`` of the ``marks`` (code, mark) with a code at most the row's,
    NULL if there is none.  Codes are not NULL."""
    n = parts or max(2, width(rows.sparkSession))
    cuts = cut_points(rows.select("code").unionByName(marks.select("code")), n)
    at = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    upto, below = _at_most(at, len(cuts), F.col("code")), _at_most(at, len(cuts), F.col("code") - 1)
    salt = F.pmod(F.xxhash64(*rows.columns), F.greatest(F.col("_upto") - F.col("_below"), F.lit(1)))
    placed_rows = rows.withColumns({"_upto": upto, "_below": below}).select(
        (F.col("_upto") - salt).cast("int").alias("_part"), "code", F.lit(1).alias("_kind"),
        F.struct(*rows.columns).alias("_row"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"))
    # A mark stands in the first part of its code, so that the others get it handed on.
    placed_marks = marks.withColumns({"_upto": upto, "_below": below}).select(
        F.least("_upto", F.col("_below") + 1).cast("int").alias("_part"), "code", F.lit(0).alias("_kind"),
        F.lit(None).cast(placed_rows.schema["_row"].dataType).alias("_row"), "mark")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    every = rows.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_part"))
    most = every.join(F.broadcast(placed_marks.groupBy("_part").agg(F.max("mark").alias("mark"))), "_part", "left")
    handed = most.select("_part", F.max("mark").over(before).alias("mark")).filter("mark IS NOT NULL").select(
        "_part", F.lit(-1).cast("bigint").alias("code"), F.lit(-1).alias("_kind"), F.lit(None).cast(placed_rows.schema["_row"].dataType).alias("_row"), "mark")
    swept = Window.partitionBy("_part").orderBy("code", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    union = placed_rows.unionByName(placed_marks).unionByName(handed)
    return union.withColumn("mark", F.max("mark").over(swept)).filter("_kind = 1").select("_row.*", "mark")

