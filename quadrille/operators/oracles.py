"""Refinement predicates: which cells split.

A predicate is SQL text (or a Column) over the columns of one cell: ``code``,
``level`` and, when ``coords`` is set, its corner ``x, y[, z]`` and its ``size``
in grid units.  ``fine`` bounds the level from which nothing splits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.morton import child_index
from quadrille.grid import Grid


@dataclass(frozen=True)
class Oracle:
    rule: Callable[[Grid], str | Column]
    coords: bool = False
    fine_level: int | None = None

    def fine(self, grid: Grid) -> int:
        return grid.max_level if self.fine_level is None else min(self.fine_level, grid.max_level)

    def splits(self, grid: Grid) -> Column:
        """Where a cell splits; never from the ``fine`` level on."""
        rule = self.rule(grid)
        return (F.col("level") < self.fine(grid)) & F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def when(rule: str | Column, coords: bool = False, fine_level: int | None = None) -> Oracle:
    """Any predicate over a cell's columns."""
    return Oracle(lambda grid: rule, coords, fine_level)


def always() -> Oracle:
    return when("true")


def never() -> Oracle:
    return when("false", fine_level=0)


@dataclass(frozen=True)
class Config:
    """Band around a circle or sphere, in units of the domain width."""

    max_level: int = 21
    radius: float = 0.25
    bandwidth: float = 0.05
    center: tuple[float, float, float] = (0.5, 0.5, 0.5)
    coarse_level: int = 3
    fine_level: int = 9

    def int_center(self, dim: int) -> list[int]:
        return [int(c * (1 << self.max_level)) for c in self.center[:dim]]


def band(cfg: Config) -> Oracle:
    """Cells that may meet a band around a circle (2D) or a sphere (3D)."""

    def rule(grid: Grid) -> str:
        deltas = [f"(CAST({a} AS DOUBLE) + CAST(size AS DOUBLE) * 0.5D - {c}.0D)"
                  for a, c in zip(grid.axes, cfg.int_center(grid.dim))]
        dist2 = " + ".join(f"{d} * {d}" for d in deltas)
        reach = f"({cfg.bandwidth * grid.width!r}D + size * {math.sqrt(grid.dim) / 2!r}D)"
        radius = f"{cfg.radius * grid.width!r}D"
        outer, inner = f"({radius} + {reach})", f"({radius} - {reach})"
        return (f"level < {cfg.coarse_level} OR (level < {cfg.fine_level} "
                f"AND {dist2} < {outer} * {outer} "
                f"AND ({inner} <= 0 OR {dist2} > {inner} * {inner}))")

    return Oracle(rule, True, max(cfg.fine_level, cfg.coarse_level))


def tower() -> Oracle:
    """Cells that hold the centre of the domain on every axis."""

    def rule(grid: Grid) -> str:
        mid = grid.width // 2
        return " AND ".join(f"{a} <= {mid}L AND {mid}L < {a} + size" for a in grid.axes)

    return Oracle(rule, True)


def crack(fine_level: int) -> Oracle:
    """Cells that straddle the mid-plane x = width / 2."""

    def rule(grid: Grid) -> str:
        mid = grid.width // 2
        return f"level < {fine_level} AND x <= {mid}L AND {mid}L < x + size"

    return Oracle(rule, True, fine_level)


def cloud(fine_level: int) -> Oracle:
    return when(f"level < {fine_level} AND (code % 7 = 0 OR code % 13 = 0)", fine_level=fine_level)


# Fixed value: the odd 64-bit multiplier of the scattered test predicates.
HASH_MULTIPLIER = 0x9E3779B97F4A7C15


def _product() -> str:
    """``code * HASH_MULTIPLIER`` modulo 2**64, as an exact decimal."""
    half = 1 << 32
    low, high = HASH_MULTIPLIER % half, HASH_MULTIPLIER // half

    def dec(text: str) -> str:
        return f"CAST({text} AS DECIMAL(20,0))"

    c_low, c_high = dec(f"code & {half - 1}L"), dec("shiftright(code, 32)")
    cross = dec(f"({c_low} * {dec(f'{high}L')} + {c_high} * {dec(f'{low}L')}) % {dec(f'{half}L')}")
    total = f"({c_low} * {dec(f'{low}L')} + {cross} * {dec(f'{half}L')})"
    return dec(f"{total} % CAST('{1 << 64}' AS DECIMAL(20,0))")


def hash_third(fine_level: int) -> Oracle:
    """A scattered third of the cells."""
    return when(f"level < {fine_level} AND {_product()} % CAST(3 AS DECIMAL(20,0)) = 0",
                fine_level=fine_level)


def hash_quarter(fine_level: int) -> Oracle:
    """A scattered quarter of the cells, chosen by two high bits of the product."""
    field = f"floor({_product()} / CAST('{1 << 40}' AS DECIMAL(20,0)))"
    return when(f"level < {fine_level} AND {field} % 4 = 0", fine_level=fine_level)


def graded() -> Oracle:
    """The root, then its last child."""
    return Oracle(lambda grid: f"level = 0 OR (level = 1 AND "
                  f"{child_index('code', 1, grid)} = {grid.children - 1})", fine_level=2)
