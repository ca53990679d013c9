"""Element geometry as SQL text over vertex coordinates ``x0, y0, z0, x1, ...``.

The columns follow the element's node order; shapes with fewer vertices leave
the last ones NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadrille.operators.shapes import H8, P5, Q4, T3, T4, W6, case, shape

Vec = tuple[str, str, str]


def at(i: int) -> Vec:
    return (f"x{i}", f"y{i}", f"z{i}")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(f"({x} - {y})" for x, y in zip(a, b))


def dot(a: Vec, b: Vec) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a: Vec, b: Vec) -> Vec:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def triple(a: Vec, b: Vec, c: Vec) -> str:
    return dot(cross(a, b), c)


def tet_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> str:
    return f"({triple(sub(b, a), sub(c, a), sub(d, a))} / 6.0D)"


# Which vertices stand at the eight corners of a hexahedron, in bit order x, y, z:
# the other shapes are hexahedra with corners collapsed.
_CORNERS = {
    H8: (0, 1, 3, 2, 4, 5, 7, 6),
    W6: (0, 1, 2, 2, 3, 4, 5, 5),
    P5: (0, 1, 3, 2, 4, 4, 4, 4),
}


def _planar_measure() -> str:
    return case({T3: "0.5D * ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))",
                 Q4: "0.5D * ((x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1))"})


def _cofactor_volume() -> str:
    """Tetrahedron volume by cofactors of the edge matrix, in a fixed order of terms."""
    u, w, t = (sub(at(i), at(0)) for i in (1, 2, 3))
    return (f"abs({u[0]} * ({w[1]} * {t[2]} - {w[2]} * {t[1]}) - {u[1]} * ({w[0]} * {t[2]} - {w[2]} * {t[0]})"
            f" + {u[2]} * ({w[0]} * {t[1]} - {w[1]} * {t[0]})) / 6.0D")


def with_measures(elements: DataFrame, dim: int) -> DataFrame:
    """Add ``signed_measure``, ``measure`` and ``length`` to elements with coordinates.

    Every trilinear solid is one formula of three triple products over its
    eight (possibly coinciding) corners.  It is evaluated in three projections,
    on columns that are never NULL, so that the generated code stays small enough
    to be compiled to machine code.
    """
    names = elements.columns
    if dim == 2:
        signed = elements.selectExpr("*", f"{_planar_measure()} AS signed_measure")
        out = signed.selectExpr("*", "abs(signed_measure) AS measure")
        return out.selectExpr("*", "sqrt(measure) AS length")
    corners = [f"coalesce({case({s: f'{c}{m[i]}' for s, m in _CORNERS.items()})}, 0.0D) AS c{c}{i}"
               for i in range(8) for c in "xyz"]
    edges = {"a": ("71",), "b": ("60",), "c": ("72",), "d": ("30",), "e": ("50",), "f": ("74",),
             "ab": ("71", "60"), "ce": ("72", "50"), "fd": ("74", "30")}
    spans = [" + ".join(f"c{c}{p[0]} - c{c}{p[1]}" for p in pairs) + f" AS {n}{c}"
             for n, pairs in edges.items() for c in "xyz"]

    def vec(n: str) -> Vec:
        return tuple(f"{n}{c}" for c in "xyz")

    solid = " + ".join(triple(*map(vec, t)) for t in (("ab", "c", "d"), ("b", "ce", "f"), ("a", "e", "fd")))
    tet = tet_volume(*(at(i) for i in range(4)))
    out = elements.selectExpr(*names, *corners).selectExpr(*names, *spans) \
        .selectExpr(*names, f"IF(shape = {T4}, {tet}, ({solid}) / 12.0D) AS signed_measure")
    out = out.selectExpr("*", f"IF(shape = {T4}, {_cofactor_volume()}, abs(signed_measure)) AS measure")
    return out.selectExpr("*", f"pow(measure, {1 / 3!r}D) AS length")


def _edges2(vs: list[Vec]) -> str:
    sums = [dot(sub(b, a), sub(b, a)) for i, a in enumerate(vs) for b in vs[i + 1:]]
    # The floor keeps flat elements finite: the double-precision epsilon.
    return f"greatest({' + '.join(sums)}, {2.0 ** -52!r}D)"


def tet_quality(vs: list[Vec]) -> str:
    return f"(12.0D * pow(3.0D * abs({tet_volume(*vs)}), {2 / 3!r}D) / {_edges2(vs)})"


def quality() -> str:
    """Mean-ratio quality of triangles and tetrahedra, NULL for other shapes."""
    v = [at(i) for i in range(4)]
    area = f"abs(0.5D * {cross(sub(v[1], v[0]), sub(v[2], v[0]))[2]})"
    return case({T3: f"({4.0 * 3 ** 0.5!r}D * {area} / {_edges2(v[:3])})", T4: tet_quality(v)})


# Fixed value: relative difference under which two split qualities are a tie.
SPLIT_TIE = 1e-9


def split_qualities() -> list[str]:
    """Worst child quality of each way to split a tetrahedron, from its ten local points.

    Points 4 to 9 are the added edge midpoints; see :func:`midpoints`.
    """
    return [f"least({', '.join(tet_quality([at(i) for i in nodes]) for _, nodes in choice)})"
            for choice in shape(T4).choices]


def midpoints() -> list[str]:
    """The midpoints a tetrahedron's refinement adds, as columns ``x4 ... z9``."""
    return [f"0.5D * {c}{a} + 0.5D * {c}{b} AS {c}{i}"
            for i, (a, b) in enumerate(shape(T4).new_nodes, start=4) for c in "xyz"]


def split_choice(q: list[str]) -> str:
    """Index of the best split; near ties go to the earliest."""
    over = f"{1 + SPLIT_TIE!r}D"
    second = f"IF({q[1]} > {q[0]} * {over}, 1, 0)"
    best = f"IF({q[1]} > {q[0]} * {over}, {q[1]}, {q[0]})"
    return f"IF({q[2]} > {best} * {over}, 2, {second})"
