"""Sums of doubles that do not depend on the order of the rows.

A floating-point sum changes in its last bits with the partitioning, so a row
near a threshold may fall on either side of it from run to run.  Here a value is
cut into integer parts of ``BITS`` bits, counted in a unit that follows from the
largest value.  Integer sums are the same in any order, are combined map-side
and stay in generated code; the driver puts the few part sums together as one
exact integer.

Values down to 2 ** -55 of the largest keep every bit; of smaller ones, what lies
below 2 ** -108 of the largest is cut off, the same for each row wherever it
lies.  A part's sum holds 2 ** 36 rows; more end the query with an overflow error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BITS, PARTS = 27, 4


@dataclass(frozen=True)
class FixedPoint:
    """Numbers below ``2 ** exponent`` in magnitude, as whole multiples of one unit."""

    exponent: int

    @classmethod
    def below(cls, largest: float | None) -> FixedPoint:
        """For values of at most ``largest`` in magnitude; None and zero count as the smallest double."""
        if largest is not None and not math.isfinite(largest):
            raise ValueError("values to be added must be finite")
        return cls(math.frexp(largest)[1] if largest else -1073)

    @property
    def bits(self) -> int:
        """Units in one, as a power of two."""
        return BITS * PARTS - self.exponent

    def parts(self, value: Column) -> list[Column]:
        """Integer parts of a value, the highest first, each with the value's sign."""
        value, out = value.cast("double"), []
        for k in range(PARTS):
            scaled = _scaled(value, BITS * (k + 1) - self.exponent)
            out.append((scaled % F.lit(float(1 << BITS))).cast("bigint"))
        return out

    def sums(self, value: Column, prefix: str = "w") -> list[Column]:
        """Aggregates from which :meth:`total` reads the sum of ``value``; NULLs are passed over."""
        return [F.sum(part).alias(f"{prefix}{k}") for k, part in enumerate(self.parts(value))]

    def total(self, row: Row, prefix: str = "w") -> int:
        """The sum in units."""
        return sum((row[f"{prefix}{k}"] or 0) << (BITS * (PARTS - 1 - k)) for k in range(PARTS))

    def units(self, value: float) -> int:
        """One value in units, cut off like the rows' values."""
        return int(Fraction(value) * Fraction(2) ** self.bits)

    def number(self, units: int) -> float:
        """The double nearest to a number of units."""
        return float(Fraction(units) / Fraction(2) ** self.bits)


def _scaled(value: Column, shift: int) -> Column:
    """``value * 2 ** shift`` in two steps, as the power alone may exceed a double."""
    half = shift // 2
    return value * F.lit(math.ldexp(1.0, half)) * F.lit(math.ldexp(1.0, shift - half))


def fixed_point(df: DataFrame, value: str) -> FixedPoint:
    """The unit for sums of a column: one scan for its largest magnitude."""
    return FixedPoint.below(df.agg(F.max(F.abs(F.col(value).cast("double")))).first()[0])


def exact_sums(df: DataFrame, value: str, *keys: str, name: str = "total") -> DataFrame:
    """Sum of ``value`` for each of ``keys``, the same double for every partitioning and order of the rows.

    NULLs are passed over; a group of NULLs alone has a NULL sum, and an empty table no groups.
    """
    unit = fixed_point(df, value)
    added = df.groupBy(*keys).agg(F.count(value).alias("_n"), *unit.sums(F.col(value), "_w"))
    parts, carry = [], F.lit(0)
    for k in reversed(range(PARTS)):  # carries move up first, so that what is added below is short
        here = F.col(f"_w{k}") + carry
        carry = F.shiftright(here, BITS) if k else F.lit(0)
        parts.append((here - F.shiftleft(carry, BITS) if k else here).cast("double"))
    out = F.lit(0.0)
    for k, part in zip(reversed(range(PARTS)), parts):
        out = out + _scaled(part, unit.exponent - BITS * (k + 1))
    return added.select(*keys, F.when(F.col("_n") > 0, out).alias(name))
