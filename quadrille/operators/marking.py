"""Bulk (Dörfler) marking.

Two rules exist and are kept apart:

``mark``         elements: an exact prefix by descending squared error, ties by
                 number, then a per-cycle cap and an element ceiling
``scalar_field`` tree leaves: an error cutoff, ties included, with a matching
                 cutoff for coarsening

Squared errors are added exactly, so the marks do not depend on how the rows are
partitioned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.grid import Grid
from quadrille.operators.tree import emit_families, families, split_flagged
from quadrille.plans.selection import crossing, prefix
from quadrille.plans.staging import stage
from quadrille.plans.sums import FixedPoint


class Status(Enum):
    SELECTED = "selected"
    NO_CANDIDATES = "no_candidates"
    FLOOR_EXHAUSTED = "floor_exhausted"
    ELEMENT_CEILING = "element_ceiling"


@dataclass(frozen=True)
class Params:
    theta: float = 0.30
    max_refine_fraction: float = 0.30
    min_element_length: float = 0.0
    max_elements: float = 0.0

    def __post_init__(self) -> None:
        if not (self.theta >= 0 and 0 < self.max_refine_fraction <= 1
                and math.isfinite(self.min_element_length) and math.isfinite(self.max_elements)):
            raise ValueError("marking parameter out of range")


@dataclass(frozen=True)
class Marking:
    """Element sets of each stage: ``elem_id`` and the columns they were chosen by."""

    status: Status
    flagged: DataFrame
    candidates: DataFrame
    marked: DataFrame
    selected: DataFrame
    elements: int = 0
    metrics: dict = field(default_factory=dict)


def flagged(ratio: Column) -> Column:
    """``ratio > 1``; NaN, which sorts above every number, is not flagged."""
    return (ratio > 1) & ~F.isnan(ratio)


def _invalid(error: Column) -> Column:
    return error.isNull() | F.isnan(error) | (F.abs(error) == F.lit(math.inf))


def _unit(largest: float | None) -> FixedPoint:
    """Unit for sums of squares of errors up to ``largest``."""
    square = (largest or 0.0) ** 2 if (largest or 0.0) < 1e154 else math.inf
    if math.isinf(square):
        raise ValueError("errors must be below 1e154, as their squares are added")
    return FixedPoint.below(square)


def _reject_repeats(rows: DataFrame, *key: str) -> None:
    """A cell or element given twice would be counted, and later emitted, twice."""
    twice = rows.groupBy(*key).count().filter("count > 1").drop("count").first()
    if twice is not None:
        raise ValueError(f"more than one error for {twice.asDict()}")


def mark(indicators: DataFrame, params: Params | None = None) -> Marking:
    """Mark elements of ``indicators(elem_id, error, ratio[, length][, growth])``.

    ``growth`` (elements added by refining one) is needed with a ceiling,
    ``length`` with a size floor.
    """
    p = params or Params()
    floor_on, ceiling_on = p.min_element_length > 0, p.max_elements > 0
    needed = {"error", "ratio"} | ({"length"} if floor_on else set()) \
        | ({"growth"} if ceiling_on else set())
    missing = needed - set(indicators.columns)
    if missing:
        raise ValueError(f"indicators lack {sorted(missing)}")
    error, is_flagged = F.col("error"), flagged(F.col("ratio"))
    long_enough = F.col("length") > 2.0 * p.min_element_length if floor_on else F.lit(True)
    candidate = is_flagged & long_enough
    nulls = sum((F.col(c).isNull().cast("int") for c in sorted(needed - {"error"})), F.lit(0))
    stats = indicators.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(_invalid(error) | (nulls > 0), 1).otherwise(0)).alias("bad"),
        F.max(F.abs(error.cast("double"))).alias("largest"),
        F.sum(is_flagged.cast("int")).alias("flagged"),
        F.sum(candidate.cast("int")).alias("candidates"),
    ).first()
    n = stats["n"]
    if stats["bad"]:
        raise ValueError("errors must be finite and every element needs its indicators")
    _reject_repeats(indicators, "elem_id")
    e2 = (error.cast("double") * error.cast("double")).alias("e2")
    unit = _unit(stats["largest"])
    growth = (F.col("growth") if "growth" in indicators.columns else F.lit(0)).cast("bigint")
    rows = indicators.select("elem_id", "error", e2, growth.alias("growth"),
                             is_flagged.alias("f"), candidate.alias("c"))
    columns = ["elem_id", "error", "e2"]
    all_flagged = rows.filter("f").select(*columns)
    none = all_flagged.filter(F.lit(False))
    if not stats["flagged"]:
        return Marking(Status.NO_CANDIDATES, all_flagged, none, none, none, n)
    if not stats["candidates"]:
        return Marking(Status.FLOOR_EXHAUSTED, all_flagged, none, none, none, n)
    candidates = stage(rows.filter("c").select(*columns, "growth", F.lit(1).alias("one")),
                       "candidates")
    total = unit.total(rows.agg(*unit.sums(F.col("e2"))).first())
    reach = prefix(candidates, "e2", "elem_id", "e2",
                   lambda cum: total > 0 and cum / total >= p.theta, unit=unit)
    marked = candidates.filter(reach.predicate("e2", "elem_id"))
    n_marked = marked.count()
    selected, n_selected = marked, n_marked
    cap = math.ceil(p.max_refine_fraction * n)
    if n_marked > cap:
        bound = prefix(marked, "e2", "elem_id", "one", lambda cum: cum >= cap)
        selected, n_selected = marked.filter(bound.predicate("e2", "elem_id")), cap
    status = Status.SELECTED
    if ceiling_on:
        budget = p.max_elements - n
        bound = prefix(selected, "e2", "elem_id", "growth", lambda cum: cum > budget,
                       inclusive=False)
        selected = selected.filter(bound.predicate("e2", "elem_id"))
        n_selected = selected.count()
        if n_selected == 0:
            status = Status.ELEMENT_CEILING
    return Marking(status, all_flagged, candidates.select(*columns), marked.select(*columns),
                   selected.select(*columns), n,
                   {"flagged": stats["flagged"], "candidates": stats["candidates"],
                    "marked": n_marked, "selected": n_selected})


@dataclass(frozen=True)
class ScalarField:
    """Error-driven marking of tree leaves; build it with :func:`scalar_field`."""

    errors: DataFrame  # code, level, error
    grid: Grid
    refine_cutoff: float
    coarsen_cutoff: float
    coarse_level: int
    fine_level: int

    def refine(self, leaves: DataFrame) -> DataFrame:
        """One pass: leaves above the cutoff, and all above the base resolution, split."""
        high = self.errors.filter(F.col("error") >= F.lit(self.refine_cutoff)) \
            .select("code", "level", F.lit(True).alias("high"))
        level = F.col("level")
        flag = (level < self.coarse_level) | ((level < self.fine_level) & F.col("high").isNotNull())
        return split_flagged(leaves.join(high, ["code", "level"], "left"), self.grid, flag)

    def refine_converge(self, leaves: DataFrame) -> DataFrame:
        """Refine until nothing splits.

        Errors belong to the leaves they were measured on, so cells created on
        the way split again only to reach the base resolution, or where they
        happen to be a measured cell; one pass per level above covers both.
        """
        shallow, deep = self.errors.filter(F.col("error") >= F.lit(self.refine_cutoff)).agg(
            F.min("level"), F.max("level")).first()
        current = leaves.agg(F.min("level")).first()[0]
        last = max(self.coarse_level, -1 if deep is None else min(deep + 1, self.fine_level))
        for _ in range(max(last - (current or 0), 0)):
            leaves = stage(self.refine(leaves), "scalar")
        return leaves

    def coarsen(self, leaves: DataFrame) -> DataFrame:
        """Merge complete families whose worst error is within the coarsening cutoff."""
        known = leaves.join(
            self.errors.select("code", "level", "error"), ["code", "level"], "left")
        groups = families(known, self.grid, F.max("error").alias("worst"),
                          F.count("error").alias("known"))
        merged = (F.col("mask") == self.grid.full_mask) & (F.col("known") == self.grid.children) \
            & (F.col("level") >= self.coarse_level) & (F.col("worst") <= F.lit(self.coarsen_cutoff))
        return emit_families(groups, self.grid, merged)


def scalar_field(errors: DataFrame, grid: Grid, theta_refine: float, theta_coarsen: float,
                 coarse_level: int, fine_level: int) -> ScalarField:
    """Cutoffs for ``errors(code, level, error)``, one row per leaf."""
    for theta in (theta_refine, theta_coarsen):
        if not 0 <= theta <= 1:
            raise ValueError("theta must be in [0, 1]")
    if coarse_level > fine_level:
        raise ValueError("coarse_level must not exceed fine_level")
    rows = errors.select("code", "level", F.col("error").cast("double").alias("error"))
    e2 = F.col("error") * F.col("error")
    rows = rows.withColumn("e2", e2).withColumn("down", -F.col("error"))
    bad, largest = rows.agg(
        F.sum(F.when(_invalid(F.col("error")) | (F.col("error") < 0) | F.col("code").isNull()
                     | F.col("level").isNull(), 1).otherwise(0)),
        F.max("error")).first()
    if bad:
        raise ValueError("errors must be finite and non-negative, one per leaf")
    unit = _unit(largest)
    total = unit.total(rows.agg(*unit.sums(F.col("e2"))).first())
    _reject_repeats(rows, "code", "level")
    refine_cutoff, coarsen_cutoff = math.inf, -math.inf
    if total and theta_refine > 0:
        at = crossing(rows, "down", "e2", lambda cum: cum >= theta_refine * total, unit=unit)
        refine_cutoff = -at.key if at else rows.agg(F.min("error")).first()[0]
    if total and theta_coarsen > 0:
        at = crossing(rows, "error", "e2", lambda cum: cum > theta_coarsen * total, unit=unit)
        if at is None:
            coarsen_cutoff = rows.agg(F.max("error")).first()[0]
        elif at.before + unit.units(at.key * at.key) <= theta_coarsen * total:
            coarsen_cutoff = at.key
        else:
            lower = rows.filter(F.col("error") < F.lit(at.key)).agg(F.max("error")).first()[0]
            coarsen_cutoff = -math.inf if lower is None else lower
    return ScalarField(rows.select("code", "level", "error"), grid, refine_cutoff, coarsen_cutoff,
                       coarse_level, fine_level)
