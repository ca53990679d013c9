"""Meshes of every shape, laid out from a table of boxes.

A box is a row with a grid position and a kind, which says what fills its cube of side 2 (a square in 2D).  Boxes that touch
must agree on the faces they share: in 2D all kinds do; in 3D a face is whole or cut along the diagonal through its low
corner, and ``FACES_CUT`` tells which.  ``layered`` stacks the kinds so that they fit.

Nodes are deduplicated by exact position with one aggregation and numbered in order of first use; elements are numbered box by
box.  Boxes are numbered in the order of their positions without a global window.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.mesh import CONSTRAINTS, InvalidMesh, Mesh, _before
from quadrille.operators.shapes import H8, P5, Q4, T3, T4, W6
from quadrille.plans.prefix import dense_ids, row_index
from quadrille.plans.staging import stage

SQUARE, RISING, FALLING = 0, 1, 2
HEXAHEDRON, PYRAMIDS, CAPPED, PATHS, PRISMS = range(5)
#: Axes (0, 1, 2) and sides (0 low, 1 high) of the faces that a kind cuts into triangles.
FACES_CUT = {HEXAHEDRON: frozenset(), PYRAMIDS: frozenset(), CAPPED: frozenset({(2, 1)}),
             PATHS: frozenset(product(range(3), range(2))), PRISMS: frozenset({(2, 0), (2, 1)})}
#: From bottom to top; the first one or the second fills the lowest layer.
LAYERS = (HEXAHEDRON, PYRAMIDS, CAPPED, PATHS, PRISMS)
CENTRE = 8


def place(point: int) -> tuple[int, int, int]:
    """Where a local point is in its box: corners are numbered by their bits x + 2y + 4z, then comes the centre."""
    return (1, 1, 1) if point == CENTRE else tuple(2 * (point >> a & 1) for a in range(3))


def _turn(points) -> int:
    """Sign of the volume spanned by four points."""
    p = [place(q) for q in points]
    u, v, w = (tuple(a - b for a, b in zip(q, p[0])) for q in p[1:])
    return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def _face(axis: int, side: int) -> list[int]:
    """The corners around a face of the cube, from its low corner."""
    one, two = (1 << a for a in range(3) if a != axis)
    return [(side << axis) + c for c in (0, one, one + two, two)]


def _pyramid(axis: int, side: int) -> tuple[int, ...]:
    a, b, c, d = _face(axis, side)
    return (a, b, c, d, CENTRE) if _turn((a, b, d, CENTRE)) > 0 else (a, d, c, b, CENTRE)


def _tet(points) -> tuple[int, ...]:
    a, b, c, d = points
    return (a, b, c, d) if _turn(points) > 0 else (a, b, d, c)


def _around_centre(cut: frozenset) -> list:
    """A pyramid on every face, two tetrahedra on those that are cut."""
    out = []
    for axis, side in product(range(3), range(2)):
        a, b, c, d = _face(axis, side)
        out += [(T4, _tet((a, b, c, CENTRE))), (T4, _tet((a, c, d, CENTRE)))] if (axis, side) in cut else [(P5, _pyramid(axis, side))]
    return out


def _paths() -> list:
    """One tetrahedron for each way from the low corner to the high one along the axes."""
    return [(T4, _tet((0, 1 << a, (1 << a) + (1 << b), 7))) for a, b, _ in permutations(range(3))]


CONTENTS = {
    2: {SQUARE: [(Q4, (0, 1, 3, 2))], RISING: [(T3, (0, 1, 3)), (T3, (0, 3, 2))], FALLING: [(T3, (0, 1, 2)), (T3, (1, 3, 2))]},
    3: {HEXAHEDRON: [(H8, (0, 1, 3, 2, 4, 5, 7, 6))], PYRAMIDS: _around_centre(FACES_CUT[PYRAMIDS]),
        CAPPED: _around_centre(FACES_CUT[CAPPED]), PATHS: _paths(),
        PRISMS: [(W6, (0, 1, 3, 4, 5, 7)), (W6, (0, 3, 2, 4, 7, 6))]},
}


def _case(values: dict[int, str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def _ints(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def layered(columns: DataFrame) -> DataFrame:
    """Boxes i, j, k, kind from columns i, j, kind: the kind (HEXAHEDRON or PYRAMIDS) fills the lowest box, and three boxes
    above it bring in every other shape."""
    above = _ints(LAYERS[2:])
    return columns.selectExpr("i", "j", f"posexplode(concat(array(CAST(kind AS INT)), {above})) AS (k, kind)")


def mismatches(boxes: DataFrame) -> DataFrame:
    """Touching boxes of which one cuts the shared face and the other does not: ``i, j, k, axis`` of the lower one."""
    cut = {side: _case({k: _ints(sorted(a for a, s in faces if s == side)) if any(s == side for _, s in faces) else "array()"
                        for k, faces in FACES_CUT.items()}) for side in (0, 1)}
    low = boxes.selectExpr("i", "j", "k", f"{cut[1]} AS cut", "explode(array(0, 1, 2)) AS axis").selectExpr(
        "i", "j", "k", "axis", "array_contains(cut, axis) AS cut_here")
    high = boxes.selectExpr("i AS hi", "j AS hj", "k AS hk", f"{cut[0]} AS cut", "explode(array(0, 1, 2)) AS axis").selectExpr(
        "hi - IF(axis = 0, 1, 0) AS i", "hj - IF(axis = 1, 1, 0) AS j", "hk - IF(axis = 2, 1, 0) AS k", "axis", "array_contains(cut, axis) AS cut_there")
    return low.join(high.hint("merge"), ["i", "j", "k", "axis"]).filter("cut_here <> cut_there").select("i", "j", "k", "axis")


def hybrid(boxes: DataFrame, dim: int, check: bool = True) -> Mesh:
    """The mesh of ``boxes``: columns i, j (k in 3D), kind.  A position may be listed once only."""
    contents, keys = CONTENTS[dim], ["i", "j", "k"][:dim]
    if check:
        known = ", ".join(map(str, contents))
        if not boxes.filter(f"kind IS NULL OR kind NOT IN ({known}) OR " + " OR ".join(f"{k} IS NULL" for k in keys)).isEmpty():
            raise InvalidMesh(f"a box without position, or of a kind other than {known}")
        if not boxes.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise InvalidMesh("two boxes at one position")
        if dim == 3 and not mismatches(boxes).isEmpty():
            raise InvalidMesh("boxes that disagree on a shared face")
    spark = boxes.sparkSession
    amounts = _case({k: str(len(c)) for k, c in contents.items()})
    numbered = stage(row_index(boxes.select(*keys, "kind"), keys, "elem_id"), "boxes")
    numbered = stage(_before(numbered, {"kids": amounts}), "boxes")

    # The points a box uses, in order of first use, and where they are.
    used = {k: list(dict.fromkeys(p for _, con in c for p in con)) for k, c in contents.items()}
    at = [f"2 * {key} + get({_ints(place(p)[a] for p in range(9))}, point) AS {c}" for a, (key, c) in enumerate(zip(keys, "xyz"))]
    points = stage(numbered.selectExpr("elem_id AS cell", *keys, f"posexplode({_case({k: _ints(p) for k, p in used.items()})}) AS (ord, point)")
                   .selectExpr("cell", "ord", "point", *at, *["0 AS z"] * (dim == 2)), "points")
    first = points.groupBy("x", "y", "z").agg(F.min(F.struct("cell", "ord")).alias("first")).selectExpr(
        "x", "y", "z", "first.cell AS cell", "first.ord AS ord")
    nodes = stage(dense_ids(first, "cell", ["cell", "ord"], "node_id"), "nodes")
    ids = points.select("cell", "point", "x", "y", "z").join(nodes.select("x", "y", "z", "node_id").hint("merge"), ["x", "y", "z"]).groupBy("cell").agg(
        *[F.max(F.when(F.col("point") == p, F.col("node_id"))).alias(f"n{p}") for p in range(9)])  # one row for each box
    local = "array(" + ", ".join(f"n{p}" for p in range(9)) + ")"
    kids = _case({k: "array(" + ", ".join(f"named_struct('shape', {s}, 'con', {_ints(con)})" for s, con in c) + ")" for k, c in contents.items()})
    elements = numbered.withColumnRenamed("elem_id", "cell").join(ids.hint("merge"), "cell").selectExpr(
        "before_kids", f"{local} AS local", f"posexplode({kids}) AS (t, c)").selectExpr(
        "CAST(before_kids + t AS INT) AS elem_id", "c.shape AS shape", "transform(c.con, p -> local[p]) AS con")
    nodes = nodes.selectExpr("node_id", *[f"CAST({c} AS DOUBLE) AS {c}" for c in "xyz"])
    return Mesh(dim, nodes, stage(elements, "elements"), spark.createDataFrame([], CONSTRAINTS))


def box_of(mesh: Mesh) -> DataFrame:
    """``elem_id`` and the box each element lies in: the one that holds its lowest coordinates."""
    keys = ["i", "j", "k"][:mesh.dim]
    corners = mesh.elements.select("elem_id", F.explode("con").alias("node_id")).join(mesh.nodes.hint("merge"), "node_id")
    return corners.groupBy("elem_id").agg(*[F.floor(F.min(c) / 2).alias(k) for k, c in zip(keys, "xyz")])

