"""What makes a mesh with hanging nodes conforming, checked from the geometry alone.

``faults`` returns one row for each broken requirement:

* ``node hangs on a hanging node`` and ``node off its parents' mean``, by constraint;
* ``position held twice``;
* ``field jumps``: a field with arbitrary values on free nodes, extended to the hanging ones by their constraints, is sampled on
  a lattice over every face (every edge in 2D), linear on triangles, bilinear on quadrilaterals.  All samples at one position
  must agree, so a missing or wrong constraint shows, and so do neighbours that refine their common face differently;
* ``node hangs unlisted`` and ``node listed without hanging``: a node hangs if it lies on the boundary of an element that does
  not have it as a vertex;
* ``element turned``: not positively oriented.

``coverage`` says how many elements contain each of some points; a mesh that tiles its domain has each point in one.

Positions are compared exactly, which fits coordinates and weights that are sums of powers of two.  Samples meet by position in
one aggregation with partial results; points meet elements by the cell of a grid as coarse as the element, level by level, so a
point asks about one cell for each size of element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import at, cross, dot, sub, with_measures
from quadrille.operators.mesh import Mesh, with_positions
from quadrille.operators.shapes import FACES, case, of_dim
from quadrille.plans.staging import stage

FAULTS = "fault STRING, item BIGINT, x DOUBLE, y DOUBLE, z DOUBLE"
#: An arbitrary value of a node, exact in double precision and far from linear in the number.
FIELD = "CAST((CAST(node_id AS BIGINT) * 7919 + (CAST(node_id AS BIGINT) DIV 3) * 104729) % 2001 - 1000 AS DOUBLE)"


def _named(rows: DataFrame, fault: str, item: str = "NULL", place: bool = False) -> DataFrame:
    return rows.selectExpr(f"'{fault}' AS fault", f"CAST({item} AS BIGINT) AS item", *[c if place else f"CAST(NULL AS DOUBLE) AS {c}" for c in "xyz"])


def field(mesh: Mesh, value: str = FIELD) -> DataFrame:
    """Nodes with ``u``: ``value`` on free nodes, the parents' weighted sum on hanging ones."""
    free = mesh.nodes.selectExpr("*", f"{value} AS u")
    parents = mesh.constraints.select("node", F.explode(F.arrays_zip("parents", "weights")).alias("t")).selectExpr(
        "node", "t.parents AS node_id", "t.weights AS w").join(free.select("node_id", "u"), "node_id")
    hung = parents.groupBy("node").agg(F.sum(F.expr("w * u")).alias("h")).withColumnRenamed("node", "node_id")
    return free.join(hung, "node_id", "left").selectExpr("node_id", "x", "y", "z", "coalesce(h, u) AS u")


def _lattice(corners: int, steps: int) -> list[tuple[float, ...]]:
    """Weights of a face's corners at the points of a lattice."""
    ticks = [i / steps for i in range(steps + 1)]
    if corners == 2:
        return [(1 - s, s) for s in ticks]
    if corners == 3:
        return [(1 - s - r, s, r) for s in ticks for r in ticks if s + r <= 1]
    return [((1 - s) * (1 - r), s * (1 - r), s * r, (1 - s) * r) for s in ticks for r in ticks]


def face_samples(mesh: Mesh, steps: int = 4, value: str = FIELD) -> DataFrame:
    """``elem_id, x, y, z, v``: the field on the faces of every element."""
    faces = case({s.code: "array(" + ", ".join("array(" + ", ".join(f"con[{v}]" for v in f) + ")" for f in FACES[s.code]) + ")"
                  for s in of_dim(mesh.dim)})
    corners = mesh.elements.selectExpr("elem_id", f"posexplode({faces}) AS (f, face)").selectExpr(
        "elem_id", "f", "size(face) AS n", "posexplode(face) AS (k, node_id)").join(field(mesh, value), "node_id")
    most = 4 if mesh.dim == 3 else 2
    rows = corners.groupBy("elem_id", "f", "n").agg(*[
        F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0.0)).alias(f"{c}{k}") for k in range(most) for c in "xyzu"])
    weights = "CASE n " + " ".join(
        f"WHEN {n} THEN array(" + ", ".join("array(" + ", ".join(f"{w!r}D" for w in (*point, *[0.0] * (most - n))) + ")" for point in _lattice(n, steps)) + ")"
        for n in ((2,) if mesh.dim == 2 else (3, 4))) + " END"
    mixed = [" + ".join(f"w[{k}] * {c}{k}" for k in range(most)) + f" AS {'v' if c == 'u' else c}" for c in "xyzu"]
    return rows.selectExpr("*", f"explode({weights}) AS w").selectExpr("elem_id", *mixed)


def faults(mesh: Mesh, steps: int = 4, value: str = FIELD) -> DataFrame:
    """One row (fault, item, x, y, z) for each fault; ``item`` is a node or element number, the place that of a position."""
    nodes, hanging = mesh.nodes, mesh.constraints
    each = hanging.select("node", F.explode(F.arrays_zip("parents", "weights")).alias("t")).selectExpr(
        "node", "t.parents AS node_id", "t.weights AS w")
    chained = each.join(hanging.selectExpr("node AS node_id"), "node_id", "left_semi").select("node").distinct()
    means = each.join(nodes, "node_id").groupBy("node").agg(*[F.sum(F.expr(f"w * {c}")).alias(f"m{c}") for c in "xyz"])
    off = means.join(nodes, means["node"] == nodes["node_id"]).filter("x <> mx OR y <> my OR z <> mz").select("node")
    twice = nodes.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    samples = stage(face_samples(mesh, steps, value), "samples")
    jumps = samples.groupBy("x", "y", "z").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low <> high")
    beside = samples.join(nodes.select("node_id", "x", "y", "z"), ["x", "y", "z"]).select("node_id", "elem_id").distinct()
    vertices = mesh.elements.select(F.explode("con").alias("node_id"), "elem_id")
    foreign = stage(beside.join(vertices, ["node_id", "elem_id"], "left_anti").select("node_id").distinct(), "foreign")
    listed = hanging.selectExpr("node AS node_id").distinct()
    turned = with_measures(with_positions(mesh.elements, nodes, mesh.dim), mesh.dim).filter("NOT signed_measure > 0")
    parts = [_named(chained, "node hangs on a hanging node", "node"), _named(off, "node off its parents'' mean", "node"),
             _named(twice, "position held twice", place=True), _named(jumps, "field jumps", place=True),
             _named(foreign.join(listed, "node_id", "left_anti"), "node hangs unlisted", "node_id"),
             _named(listed.join(foreign, "node_id", "left_anti"), "node listed without hanging", "node_id"),
             _named(turned, "element turned", "elem_id")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _inside(dim: int) -> str:
    """Whether the point (px, py, pz) is strictly inside the element."""
    point = ("px", "py", "pz")

    def beyond(face: tuple[int, ...]) -> str:
        a, b = at(face[0]), at(face[1])
        if dim == 2:
            return f"((y{face[1]} - y{face[0]}) * (px - x{face[0]}) - (x{face[1]} - x{face[0]}) * (py - y{face[0]}) < 0)"
        return f"({dot(cross(sub(b, a), sub(at(face[2]), a)), sub(point, a))} < 0)"

    return case({s.code: "(" + " AND ".join(beyond(f) for f in FACES[s.code]) + ")" for s in of_dim(dim)})


def coverage(mesh: Mesh, points: DataFrame) -> DataFrame:
    """``pid, elements``: in how many elements each of ``points`` (pid, x, y, z) is.  Points on a face are in neither side's."""
    dim, axes = mesh.dim, "xyz"[:mesh.dim]
    n = max(s.vertices for s in of_dim(dim))
    placed = with_positions(mesh.elements, mesh.nodes, dim)
    low = {c: "least(" + ", ".join(f"{c}{i}" for i in range(n)) + ")" for c in axes}
    high = {c: "greatest(" + ", ".join(f"{c}{i}" for i in range(n)) + ")" for c in axes}
    extent = "greatest(" + ", ".join(f"{high[c]} - {low[c]}" for c in axes) + ")"
    sized = placed.selectExpr("*", f"CAST(ceil(log2({extent})) AS INT) AS level")
    cells = sized
    for c in axes:  # a point inside lies below the upper bound, so a cell that begins there holds none
        first, last = f"CAST(floor({low[c]} / pow(2, level)) AS BIGINT)", f"CAST(ceil({high[c]} / pow(2, level)) AS BIGINT) - 1"
        cells = cells.selectExpr("*", f"explode(sequence({first}, greatest({first}, {last}))) AS c{c}")
    cells = stage(cells, "cells")
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # one for each size of element, by powers of two
    asked = points.selectExpr("pid", *[f"CAST({c} AS DOUBLE) AS p{c}" for c in "xyz"])
    if not levels:
        return asked.selectExpr("pid", "CAST(0 AS BIGINT) AS elements")
    probes = asked.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)]))).selectExpr(
        "*", *[f"CAST(floor(p{c} / pow(2, level)) AS BIGINT) AS c{c}" for c in axes])
    found = probes.join(cells.hint("merge"), ["level", *[f"c{c}" for c in axes]]).filter(_inside(dim)).groupBy("pid").agg(F.count(F.lit(1)).alias("elements"))
    return asked.select("pid").join(found.hint("merge"), "pid", "left").selectExpr("pid", "coalesce(elements, 0) AS elements")
