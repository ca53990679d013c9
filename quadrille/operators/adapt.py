"""One mark-balance-refine cycle on an unstructured mesh."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import with_measures
from quadrille.operators.marking import Marking, Params, Status, mark
from quadrille.operators.mesh import Mesh, Refinement, closure, ranked_closure, refine, validate, with_positions
from quadrille.operators.shapes import case, of_dim
from quadrille.plans.selection import prefix
from quadrille.plans.staging import stage_packed as stage


class AdaptStatus(IntEnum):
    REFINED = 0
    STAGNATED = 1
    NO_CANDIDATES = 2
    FLOOR_EXHAUSTED = 3
    ELEMENT_CEILING = 4


_STOPPED = {Status.NO_CANDIDATES: AdaptStatus.NO_CANDIDATES,
            Status.FLOOR_EXHAUSTED: AdaptStatus.FLOOR_EXHAUSTED,
            Status.ELEMENT_CEILING: AdaptStatus.ELEMENT_CEILING}


@dataclass(frozen=True)
class AdaptParams:
    marking: Params = field(default_factory=Params)
    min_growth_fraction: float = 0.0

    def __post_init__(self) -> None:
        if not 0 <= self.min_growth_fraction < 1:
            raise ValueError("min_growth_fraction must be in [0, 1)")


@dataclass(frozen=True)
class Adaptation:
    status: AdaptStatus
    marking: Marking
    selected: DataFrame
    balanced: DataFrame | None = None
    refinement: Refinement | None = None
    seconds: tuple[float, float, float] = (0.0, 0.0, 0.0)


def element_growth(dim: int) -> str:
    """Elements added by refining one element, as SQL text."""
    return case({s.code: str(s.children - 1) for s in of_dim(dim)})


def element_lengths(mesh: Mesh) -> DataFrame:
    """``elem_id, length``: measure to the power 1 / dim."""
    return with_measures(with_positions(mesh.elements, mesh.nodes, mesh.dim), mesh.dim) \
        .select("elem_id", "length")


def _within(mesh: Mesh, selected: DataFrame, budget: float) -> tuple[DataFrame, DataFrame]:
    """The longest prefix of the selection whose closure adds at most ``budget`` elements, and that closure.

    Each element of the whole selection's closure belongs to the first selected one that reaches it, so what a prefix adds
    is a running sum over the selection, and both results are filters on the marking order.
    """
    ranks = stage(ranked_closure(mesh, selected).join(mesh.elements.selectExpr("elem_id", f"CAST({element_growth(mesh.dim)} AS BIGINT) AS growth").hint("merge"), "elem_id"), "ranks")
    sums = stage(ranks.groupBy("source", "e2").agg(F.sum("growth").alias("growth")), "sums")
    bound = prefix(sums, "e2", "source", "growth", lambda cum: cum > budget, inclusive=False)
    return selected.filter(bound.predicate("e2", "elem_id")), ranks.filter(bound.predicate("e2", "source")).select("elem_id")


def adapt(mesh: Mesh, indicators: DataFrame, params: AdaptParams | None = None) -> Adaptation:
    """Mark by ``indicators(elem_id, error, ratio)``, close, respect the ceiling, refine."""
    p = params or AdaptParams()
    validate(mesh)
    t0 = time.perf_counter()
    rows = mesh.elements.selectExpr("elem_id", f"{element_growth(mesh.dim)} AS growth")
    given = indicators.select("elem_id", "error", "ratio")
    joined = stage(rows.join(given.hint("merge"), "elem_id", "full"), "indicators")
    if not joined.filter("growth IS NULL OR error IS NULL OR ratio IS NULL").isEmpty():
        raise ValueError("error and ratio need one value per element")
    n = mesh.elements.count()
    if joined.count() != n:  # each element has a value, so a second one makes a row more
        raise ValueError("error and ratio need one value per element")
    if p.marking.min_element_length > 0:
        joined = stage(joined.join(element_lengths(mesh).hint("merge"), "elem_id"), "indicators")
    marking = mark(joined, p.marking)
    marked_at = time.perf_counter()
    if marking.status in _STOPPED:
        return Adaptation(_STOPPED[marking.status], marking, marking.selected,
                          seconds=(marked_at - t0, 0.0, 0.0))
    selected = marking.selected
    if p.marking.max_elements > 0:
        selected, balanced = _within(mesh, selected, p.marking.max_elements - n)
        balanced = stage(balanced, "balanced")
        if balanced.isEmpty():
            return Adaptation(AdaptStatus.ELEMENT_CEILING, marking, marking.selected.limit(0),
                              seconds=(marked_at - t0, time.perf_counter() - marked_at, 0.0))
    else:
        balanced = stage(closure(mesh, selected, check=False), "balanced")
    closed_at = time.perf_counter()
    refinement = refine(mesh, balanced, check=False)
    grown = (refinement.mesh.elements.count() - n) / max(n, 1)
    stagnated = p.min_growth_fraction > 0 and grown < p.min_growth_fraction
    return Adaptation(AdaptStatus.STAGNATED if stagnated else AdaptStatus.REFINED, marking, selected,
                      balanced, refinement,
                      (marked_at - t0, closed_at - marked_at, time.perf_counter() - closed_at))


