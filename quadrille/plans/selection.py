"""Weighted prefix selection without sorting.

"The first rows, by descending value, whose weights add up to T" needs only the
row where the running weight crosses T.  Each round aggregates the rows of the
current value range into a fixed number of buckets (combined map-side, so a hot
value costs nothing), the driver walks the bucket totals, and the range shrinks
to the crossing bucket.  Ties are resolved the same way on the row number.  The
result is a filter, so the selected rows are never shuffled or sorted.

Weights are added as exact integers, either their own or, for doubles, those of
a :class:`FixedPoint`, so where the sum crosses does not depend on the
partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.sums import FixedPoint

BUCKETS = 4096


@dataclass(frozen=True)
class Crossing:
    """Key at which the running weight crosses, and the weight before that key."""

    key: float
    before: int
    weight: int
    rows: int


def crossing(df: DataFrame, key: str, weight: str, crossed: Callable[[int], bool],
             start: int = 0, unit: FixedPoint | None = None) -> Crossing | None:
    """Crossing key in ascending order of ``key``; None if the weights never cross.

    Weights are integers, or doubles counted in a ``unit``; ``crossed`` is asked in the same unit.
    """
    weights = unit.sums(F.col(weight)) if unit else [F.sum(F.col(weight).cast("bigint")).alias("w")]

    def weighed(row) -> int:
        return unit.total(row) if unit else row["w"]

    bounds = df.agg(F.min(key), F.max(key)).first()
    lo, hi = bounds[0], bounds[1]
    before = start
    if lo is None:
        return None
    while True:
        rows = df.filter((F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi)))
        if hi > lo:
            span = float(hi) / 2 - float(lo) / 2
            raise_by = 2.0 ** 600 if span < 2.0 ** -900 else 1.0  # so that no quotient exceeds a double
            bottom = float(lo) * raise_by / 2
            scale = F.lit(BUCKETS / (float(hi) * raise_by / 2 - bottom or 1.0))
            share = (F.col(key).cast("double") * F.lit(raise_by) / 2 - F.lit(bottom)) * scale
            bucket = F.least(F.floor(share), F.lit(BUCKETS - 1))
        else:
            bucket = F.lit(0)
        totals = rows.groupBy(bucket.alias("b")).agg(
            F.min(key).alias("lo"), F.max(key).alias("hi"),
            *weights, F.count(F.lit(1)).alias("n")).collect()
        for b in sorted(totals, key=lambda r: r["b"]):
            if crossed(before + weighed(b)):
                break
            before += weighed(b)
        else:
            return None
        if b["lo"] == b["hi"]:
            return Crossing(b["lo"], before, weighed(b), b["n"])
        if (b["lo"], b["hi"]) == (lo, hi):  # keys beyond double precision: halve the range
            middle = lo + (hi - lo) // 2 if isinstance(lo, int) else min(lo / 2 + hi / 2, math.nextafter(hi, lo))
            half = df.filter((F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(middle)))
            low = weighed(half.agg(*weights).first())
            if crossed(before + low):
                hi = middle
            else:
                before, lo = before + low, middle + 1 if isinstance(lo, int) else hi
            continue
        lo, hi = b["lo"], b["hi"]


@dataclass(frozen=True)
class Prefix:
    """Rows before ``(key, row)`` in descending key, ascending row order."""

    key: float | None = None
    row: int | None = None
    inclusive: bool = True

    def predicate(self, key: str, row: str) -> Column:
        if self.key is None:
            return F.lit(True)
        within = F.col(row) <= self.row if self.inclusive else F.col(row) < self.row
        return (F.col(key) > F.lit(self.key)) | ((F.col(key) == F.lit(self.key)) & within)


def prefix(df: DataFrame, key: str, row: str, weight: str, crossed: Callable[[int], bool],
           inclusive: bool = True, unit: FixedPoint | None = None) -> Prefix:
    """Prefix of ``df`` by descending ``key``, ascending ``row``, up to the crossing row.

    With ``inclusive`` the crossing row belongs to the prefix; if the weights
    never cross, every row does.
    """
    keyed = df.withColumn("_key", -F.col(key))
    at = crossing(keyed, "_key", weight, crossed, unit=unit)
    if at is None:
        return Prefix()
    ties = df.filter(F.col(key) == F.lit(-at.key))
    if at.rows == 1:
        return Prefix(-at.key, ties.agg(F.min(row)).first()[0], inclusive)
    tie = crossing(ties, row, weight, crossed, at.before, unit)
    return Prefix(-at.key, tie.key if tie else ties.agg(F.max(row)).first()[0], inclusive)


def random_subset(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``ceil(fraction * rows)`` of the rows, those of the largest hashes of ``seed`` and ``key``.

    The same rows for every partitioning; two seeds choose independently.  ``key`` names an integer column without
    repeats or NULLs.  The threshold is found by counts per range of hashes, so nothing is sorted or shuffled.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in [0, 1]")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    hashed = df.select("*", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("_hash"), F.lit(1).alias("_one"))
    n, present = hashed.agg(F.count(F.lit(1)), F.count(key)).first()
    if present < n:
        raise ValueError(f"{key} is NULL in some rows")
    take = math.ceil(fraction * n)
    if not take:
        return df.filter(F.lit(False))
    bound = prefix(hashed, "_hash", key, "_one", lambda taken: taken >= take)
    return hashed.filter(bound.predicate("_hash", key)).select(*df.columns)
