"""Queries over element marking and unstructured meshes."""

from __future__ import annotations

import math
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geometry as geo
from quadrille.operators import locate as L
from quadrille.operators import marking as K
from quadrille.operators import mesh as U
from quadrille.operators import shapes as S
from quadrille.operators.adapt import AdaptParams, adapt, element_growth
from quadrille.operators.structured import bump_indicator, structured
from quadrille.plans.selection import random_subset
from quadrille.plans.staging import new_path, stage
from quadrille.plans.sums import exact_sums
from quadrille.sources.smx2 import read_smx2, write_smx2
from quadrille.workload import mesh_sql as Q
from quadrille.workload import tree_sql as TS
from quadrille.workload.inputs import LINES, MESH_COLUMNS, mesh_nodes
from quadrille.workload.registry import query
from quadrille.workload.trees import _make_parent

G = LINES.grid

# --- element marking: one element per order ---------------------------------------

FLOOR = 1.5
# What ends the selection: theta and beta, and tenths of the elements by which they may grow.
_DECIDES = {"theta": (0.1, 0.5, 90), "cap": (0.2, 0.05, 90), "ceiling": (0.2, 0.5, 3)}
_DECIDES["target"] = (0.4, 0.1, 90)  # of mark_marked: theta as large as it was first, so that no marked row is left out
_RATIO = ("CASE WHEN o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (o_orderkey * 104729) % 10 < 4 "
          "THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS ratio")
_LENGTH = "CAST(1 + o_custkey % 8 AS DOUBLE) AS length"
_GROWTH = "CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 7 END AS INT) AS growth"
_ELEMENTS = ["o_orderkey AS elem_id", "floor(o_totalprice / 100) * CAST(1 AS DOUBLE) AS error",
             _RATIO, _LENGTH, _GROWTH]


def _indicators(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_ELEMENTS)


def _mark_sql(decides: str) -> str:
    theta, beta, tenths = _DECIDES[decides]
    return (f"WITH el AS (SELECT {', '.join(_ELEMENTS)} FROM orders), "
            "fl AS (SELECT * FROM el WHERE ratio > 1 AND NOT isnan(ratio)), "
            f"ca AS (SELECT * FROM fl WHERE length > {2 * FLOOR}), "
            "tt AS (SELECT sum(error * error) AS total, count(*) AS n FROM el), "
            "cu AS (SELECT *, sum(error * error) OVER w AS cum, row_number() OVER w AS rn FROM ca "
            "WINDOW w AS (ORDER BY error * error DESC, elem_id ROWS UNBOUNDED PRECEDING)), "
            f"mk AS (SELECT * FROM cu, tt WHERE rn = 1 OR (cum - error * error) / total < {theta}), "
            f"cp AS (SELECT *, sum(growth) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM mk "
            f"WHERE rn <= ceil({beta} * n)), "
            f"se AS (SELECT * FROM cp WHERE used <= ({tenths} * n) // 10)")


def _mark(spark: SparkSession, sf: str, decides: str = "ceiling") -> K.Marking:
    theta, beta, tenths = _DECIDES[decides]
    rows = _indicators(spark, sf)
    n = rows.count()
    return K.mark(rows, K.Params(theta, beta, FLOOR, n + tenths * n // 10))


for _stage, _cte in (("flagged", "fl"), ("candidates", "ca"), ("marked", "mk"), ("selected", "se")):
    def _make(name: str, cte: str, by: str) -> None:
        @query(f"mark_{name}", f"{_mark_sql(by)} SELECT elem_id, error FROM {cte}")
        def marked(spark, sf):
            return getattr(_mark(spark, sf, by), name).select("elem_id", "error")

    _make(_stage, _cte, "target" if _stage == "marked" else "ceiling")


def _decided(by: str, name: str) -> None:
    if by != "ceiling":
        @query(f"mark_selected{name}", f"{_mark_sql(by)} SELECT elem_id, error FROM se")
        def selected(spark, sf):
            return _mark(spark, sf, by).selected.select("elem_id", "error")

    @query(f"mark_status{name}", f"{_mark_sql(by)} SELECT 'selected' AS status, (SELECT count(*) FROM fl) AS flagged, "
           "(SELECT count(*) FROM ca) AS candidates, (SELECT count(*) FROM mk) AS marked, (SELECT count(*) FROM se) AS selected")
    def mark_status(spark, sf):
        m = _mark(spark, sf, by)
        return m.selected.agg(F.lit(m.status.value).alias("status"), *[
            F.lit(m.metrics[k]).cast("bigint").alias(k) for k in ("flagged", "candidates", "marked")],
            F.count(F.lit(1)).alias("selected"))


for _by, _name in (("ceiling", ""), ("theta", "_by_theta"), ("cap", "_by_cap")):
    _decided(_by, _name)


# Errors that are no integers: the twin adds their squares exactly too, as integers in units of 2 ** -60.
_SEVENTH = ["o_orderkey AS elem_id", "o_totalprice / CAST(7 AS DOUBLE) AS error", "CAST(1.5 AS DOUBLE) AS ratio"]
_UNITS = "CAST({} * CAST(1152921504606846976 AS DOUBLE) AS HUGEINT)"


@query("mark_fractional", f"WITH el AS (SELECT {', '.join(_SEVENTH)} FROM orders), sq AS (SELECT elem_id, error, "
       f"error * error AS e2, {_UNITS.format('error * error')} AS w FROM el), tt AS (SELECT CAST(sum(w) AS DOUBLE) AS total FROM sq), "
       "cu AS (SELECT *, sum(w) OVER (ORDER BY e2 DESC, elem_id ROWS UNBOUNDED PRECEDING) AS cum FROM sq) "
       "SELECT elem_id, error FROM cu, tt WHERE CAST(cum - w AS DOUBLE) / total < 0.4 OR cum = w")
def mark_fractional(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*_SEVENTH)
    return K.mark(rows, K.Params(0.4, 1.0)).marked.select("elem_id", "error")


_PAID = "l_extendedprice * (CAST(1 AS DOUBLE) - l_discount)"


@query("exact_sums", f"SELECT l_suppkey, round(CAST(sum({_UNITS.format(_PAID)}) AS DOUBLE) / 1152921504606846976, 4) AS paid "
       "FROM lineitem GROUP BY l_suppkey")
def paid_to_suppliers(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey", f"{_PAID} AS paid")
    return exact_sums(rows, "paid", "l_suppkey", name="paid").withColumn("paid", F.round("paid", 4))


def _drawn_sql(fraction: float, seed: int) -> str:
    digest = f"CAST('0x' || substr(md5('{seed}:' || o_orderkey), 1, 15) AS BIGINT)"
    return (f"SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY {digest} DESC, o_orderkey) AS rn, "
            f"count(*) OVER () AS n FROM orders) WHERE rn <= ceil({fraction} * n)")


for _fraction, _seed in ((0.3, 0), (0.01, 7)):
    def _draw(fraction: float, seed: int) -> None:
        @query(f"random_subset_{seed}", _drawn_sql(fraction, seed))
        def drawn(spark, sf):
            rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
            return random_subset(rows, fraction, "o_orderkey", seed)

    _draw(_fraction, _seed)


# --- error-driven tree marking -------------------------------------------------------

_THETA_R, _THETA_C, _COARSE, _FINE = 0.3, 0.02, 5, 9
_ERR = (TS.tree(LINES) + f", pc AS (SELECT w, {TS.enc(G, level=None)} AS code FROM pts), "
        "er AS (SELECT l.code, l.level, l.x, l.y, CAST(coalesce(max(p.w) // 100, 0) AS DOUBLE) AS error FROM leaves l "
        f"LEFT JOIN pc p ON p.code BETWEEN l.code AND {TS.end(G)} GROUP BY ALL), "
        "tt AS (SELECT sum(error * error) AS total FROM er), "
        "dn AS (SELECT error, sum(error * error) OVER (ORDER BY error DESC ROWS UNBOUNDED PRECEDING) AS cum FROM er), "
        "up AS (SELECT error, sum(error * error) OVER (ORDER BY error ROWS UNBOUNDED PRECEDING) AS cum FROM er), "
        f"cut AS (SELECT (SELECT max(error) FROM dn, tt WHERE cum >= {_THETA_R} * total) AS hi, "
        f"(SELECT max(error) FROM up, tt WHERE cum <= {_THETA_C} * total) AS lo)")
_SPLIT = f"(level < {_COARSE} OR (level < {_FINE} AND error >= hi))"


def _leaf_errors(spark, sf) -> DataFrame:
    leaves = stage(LINES.tree(spark, sf))
    worst = L.aggregate_by_leaf(LINES.load(spark, sf), leaves, G, F.max("w").alias("w"))
    errors = leaves.join(worst.selectExpr("leaf_code AS code", "leaf_level AS level", "w"),
                         ["code", "level"], "left")
    return stage(errors.selectExpr("code", "level", "CAST(coalesce(w DIV 100, 0) AS DOUBLE) AS error"))


def _field(spark, sf) -> tuple[DataFrame, K.ScalarField]:
    errors = _leaf_errors(spark, sf)
    return errors.select("code", "level"), K.scalar_field(errors, G, _THETA_R, _THETA_C, _COARSE, _FINE)


@query("scalar_field_errors", _ERR + " SELECT code, level, error FROM er")
def scalar_field_errors(spark, sf):
    return _leaf_errors(spark, sf)


@query("scalar_field_cutoffs", _ERR + " SELECT hi AS refine_cutoff, lo AS coarsen_cutoff, count(*) FILTER "
       "(error >= hi) AS high, count(*) FILTER (error <= lo) AS low FROM er, cut GROUP BY hi, lo")
def scalar_field_cutoffs(spark, sf):
    _, f = _field(spark, sf)
    return f.errors.agg(F.lit(f.refine_cutoff).alias("refine_cutoff"), F.lit(f.coarsen_cutoff).alias("coarsen_cutoff"),
                        F.count(F.when(F.col("error") >= f.refine_cutoff, 1)).alias("high"),
                        F.count(F.when(F.col("error") <= f.coarsen_cutoff, 1)).alias("low"))


_BITS = "(VALUES (0), (1)) AS p(ox), (VALUES (0), (1)) AS q(oy)"


@query("scalar_field_refine", _ERR + f", nx AS (SELECT level, x, y FROM er, cut WHERE NOT {_SPLIT} UNION ALL "
       f"SELECT level + 1, 2 * x + ox, 2 * y + oy FROM er, cut, {_BITS} WHERE {_SPLIT}) "
       f"SELECT {TS.enc(G)} AS code, level FROM nx")
def scalar_field_refine(spark, sf):
    leaves, f = _field(spark, sf)
    return f.refine(leaves)


@query("scalar_field_converge", _ERR + ", gr AS (SELECT level, x, y, error FROM er UNION ALL "
       f"SELECT level + 1, 2 * x + ox, 2 * y + oy, -1 FROM gr, cut, {_BITS} WHERE {_SPLIT}) "
       f"SELECT {TS.enc(G)} AS code, level FROM gr, cut WHERE NOT {_SPLIT}")
def scalar_field_converge(spark, sf):
    leaves, f = _field(spark, sf)
    return f.refine_converge(leaves)


@query("scalar_field_coarsen", _ERR + ", fam AS (SELECT level - 1 AS level, x >> 1 AS x, y >> 1 AS y FROM er, cut "
       f"WHERE level > 0 GROUP BY ALL HAVING count(*) = 4 AND max(error) <= any_value(lo)), "
       f"gone AS (SELECT * FROM fam WHERE level >= {_COARSE}) SELECT {TS.enc(G)} AS code, CAST(level AS INT) AS level FROM gone "
       "UNION ALL SELECT code, level FROM er WHERE (level - 1, x >> 1, y >> 1) NOT IN (SELECT (level, x, y) FROM gone)")
def scalar_field_coarsen(spark, sf):
    leaves, f = _field(spark, sf)
    return f.coarsen(leaves)


# --- element geometry: one element per order line -------------------------------------

# Reference vertices of each shape.
_SQUARE = ((0, 0), (1, 0), (1, 1), (0, 1))
_REFERENCE = {
    S.T3: ((0, 0, 0), (1, 0, 0), (0, 1, 0)),
    S.Q4: tuple((x, y, 0) for x, y in _SQUARE),
    S.T4: ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)),
    S.H8: tuple((x, y, z) for z in (0, 1) for x, y in _SQUARE),
    S.W6: tuple((x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (0, 1))),
    S.P5: (*((x, y, 0) for x, y in _SQUARE), (0, 0, 1)),
}


def _int_div(a: str, b: int, duck: bool) -> str:
    return f"{a} // {b}" if duck else f"{a} DIV {b}"


def _vertex_columns(dim: int, codes: list[int], duck: bool) -> list[str]:
    """Vertex coordinates by shape: the reference element, eight times as large, shaken by the row."""
    out = []
    for v in range(max(len(_REFERENCE[c]) for c in codes)):
        for a, name in enumerate("xyz"):
            values = ", ".join(str(8 * _REFERENCE[c][v][a]) if v < len(_REFERENCE[c]) else "NULL" for c in codes)
            base = f"[{values}][s + 1]" if duck else f"get(array({values}), s)"
            shake = f"({_int_div('h', 3 * v + a + 1, duck)}) % 3" if a < dim else "0"
            out.append(f"CAST({base} + {shake} AS DOUBLE) AS {name}{v}")
    return out


def _shape_column(codes: list[int], pick: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(codes))
    return f"CAST(CASE {pick} {whens} END AS INT) AS shape"


def _row_columns(codes: list[int]) -> list[str]:
    return ["l_orderkey * 8 + l_linenumber AS elem_id", f"l_linenumber % {len(codes)} AS s", _shape_column(codes, f"l_linenumber % {len(codes)}"),
            "l_orderkey * 7 + l_partkey * 5 + l_linenumber AS h"]


def _line_elements(spark: SparkSession, sf: str, dim: int, codes: list[int]) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_row_columns(codes))
    return rows.selectExpr("elem_id", "shape", *_vertex_columns(dim, codes, duck=False))


def _duck_elements(dim: int, codes: list[int]) -> str:
    return (f"lr AS (SELECT {', '.join(_row_columns(codes))} FROM lineitem), "
            f"lp AS (SELECT elem_id, shape, {', '.join(_vertex_columns(dim, codes, duck=True))} FROM lr)")


def _duck_tet(a, b, c, d) -> str:
    u, v, w = ([f"({q[k]} - {a[k]})" for k in range(3)] for q in (b, c, d))
    return (f"(({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) + {u[1]} * ({v[2]} * {w[0]} - {v[0]} * {w[2]}) "
            f"+ {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]})) / 6)")


def _faces(points) -> list[list[int]]:
    """Faces of a convex solid, each turning left as seen from outside: the planes through three corners that have no
    corner beyond them, and the corners on those planes in the order of their angles."""
    minus = lambda p, q: tuple(x - y for x, y in zip(p, q))
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    cross = lambda p, q: (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    found = {}
    for i, j, k in permutations(range(len(points)), 3):
        out = cross(minus(points[j], points[i]), minus(points[k], points[i]))
        heights = [dot(out, minus(p, points[i])) for p in points]
        if max(heights) < 1e-9 < -min(heights):
            on = [m for m, h in enumerate(heights) if h > -1e-9]
            middle = tuple(sum(points[m][a] for m in on) / len(on) for a in range(3))
            right = minus(points[on[0]], middle)
            up = cross(out, right)
            found[tuple(on)] = sorted(on, key=lambda m: math.atan2(dot(up, minus(points[m], middle)) / math.sqrt(dot(out, out)),
                                                                   dot(right, minus(points[m], middle))))
    return list(found.values())


def _duck_measure(code: int) -> str:
    v = [tuple(f"{c}{i}" for c in "xyz") for i in range(8)]
    if code in (S.T3, S.Q4):
        n = len(_REFERENCE[code])
        terms = " + ".join(f"(x{i} * y{(i + 1) % n} - x{(i + 1) % n} * y{i})" for i in range(n))
        return f"(({terms}) / 2)"
    apex, total = v[0], []
    for face in _faces(_REFERENCE[code]):
        f = [v[i] for i in face]
        if len(f) == 3:
            total.append(_duck_tet(apex, *f))
        else:  # a bilinear face counts as the mean of its two diagonal splits
            for t in ((0, 1, 2), (0, 2, 3), (0, 1, 3), (1, 2, 3)):
                total.append(_duck_tet(apex, *(f[i] for i in t)) + " / 2")
    return f"({' + '.join(total)})"


def _duck_quality(code: int) -> str:
    v = [tuple(f"{c}{i}" for c in "xyz") for i in range(len(_REFERENCE[code]))]
    edges = " + ".join(f"({a} - {b}) * ({a} - {b})" for p, q in combinations(v, 2) for a, b in zip(p, q))
    m = f"abs({_duck_measure(code)})"
    return f"4 * sqrt(3::DOUBLE) * {m} / ({edges})" if code == S.T3 else f"12 * pow(3 * {m}, 2.0::DOUBLE / 3) / ({edges})"


def _geometry(dim: int, codes: list[int]) -> None:
    with_points = f"WITH {_duck_elements(dim, codes)}"
    signed = "CASE shape " + " ".join(f"WHEN {c} THEN {_duck_measure(c)}" for c in codes) + " END"

    @query(f"element_measure_{dim}d", f"{with_points}, m AS (SELECT elem_id, shape, {signed} AS s FROM lp) "
           "SELECT elem_id, shape, round(s, 6) AS signed_measure, round(abs(s), 6) AS measure, "
           f"round(pow(abs(s), {1.0 / dim!r}::DOUBLE), 6) AS length FROM m")
    def measure(spark, sf):
        rows = _line_elements(spark, sf, dim, codes)
        return geo.with_measures(rows, dim).selectExpr(
            "elem_id", "shape", *[f"round({c}, 6) AS {c}" for c in ("signed_measure", "measure", "length")])

    simplex = S.T3 if dim == 2 else S.T4

    @query(f"simplex_quality_{dim}d", f"{with_points} SELECT elem_id, round({_duck_quality(simplex)}, 9) AS quality "
           f"FROM lp WHERE shape = {simplex}")
    def quality(spark, sf):
        rows = _line_elements(spark, sf, dim, codes).filter(F.col("shape") == simplex)
        return rows.selectExpr("elem_id", f"round({geo.quality()}, 9) AS quality")


_geometry(2, [S.T3, S.Q4])
_geometry(3, [S.T4, S.H8, S.W6, S.P5])

_LOCAL = ", ".join([f"{{'x': x{i}, 'y': y{i}, 'z': z{i}}}" for i in range(4)] + [
    "{" + ", ".join(f"'{c}': ({c}{a} + {c}{b}) / 2" for c in "xyz") + "}" for a, b in S.shape(S.T4).new_nodes])


@query("split_choice", f"WITH {_duck_elements(3, [S.T4])}, pp AS (SELECT elem_id AS e, [{_LOCAL}] AS p FROM lp), "
       + Q.choice("pp", "ch") + " SELECT e AS elem_id, CAST(choice AS INT) AS choice FROM ch")
def split_choice(spark, sf):
    rows = _line_elements(spark, sf, 3, [S.T4])
    worst = [f"{e} AS q{i}" for i, e in enumerate(geo.split_qualities())]
    return rows.selectExpr("*", *geo.midpoints()).selectExpr("elem_id", *worst).selectExpr(
        "elem_id", f"{geo.split_choice(['q0', 'q1', 'q2'])} AS choice")


# --- meshes sized by a table -------------------------------------------------------------

_SOURCE = {2: ("orders", "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) % 1000"),
           3: ("part", "p_partkey", "CAST(floor(p_retailprice) AS BIGINT) * (p_size % 7) % 1000")}


def seed_mesh(spark: SparkSession, sf: str, dim: int) -> U.Mesh:
    table, key, _ = _SOURCE[dim]
    nodes = mesh_nodes(spark, sf, table, key, dim)
    return structured(spark, [n - 1 for n in nodes], nodes, [0] * dim)


def first_indicators(spark: SparkSession, sf: str, mesh: U.Mesh) -> DataFrame:
    """Errors of the first cycle from the table row of each cell."""
    table, key, error = _SOURCE[mesh.dim]
    rows = spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(f"CAST({key} AS INT) AS cell", f"{error} AS err")
    per = 2 if mesh.dim == 2 else 6
    cells = mesh.elements.selectExpr("elem_id", f"CAST(elem_id DIV {per} AS INT) AS cell")
    return cells.join(rows.hint("merge"), "cell", "left").selectExpr(
        "elem_id", "CAST(coalesce(err, 0) AS DOUBLE) AS error",
        "IF((elem_id * 104729L) % 10 < 3, 1.5D, 0.5D) AS ratio")


def later_indicators(mesh: U.Mesh) -> DataFrame:
    return mesh.elements.selectExpr("elem_id", "CAST((elem_id * 7919L) % 1000 AS DOUBLE) AS error",
                                    "IF((elem_id * 104729L) % 10 < 3, 1.5D, 0.5D) AS ratio")


PARAMS = AdaptParams(K.Params(0.15, 0.30))


def _cycle(spark: SparkSession, sf: str, dim: int, n: int):
    """Result of cycle ``n`` and the mesh it started from, computed from the tables each time."""
    if n == 0:
        mesh = seed_mesh(spark, sf, dim).staged()
        return adapt(mesh, first_indicators(spark, sf, mesh), PARAMS), mesh
    before = _cycle(spark, sf, dim, n - 1)[0].refinement.mesh
    return adapt(before, later_indicators(before), PARAMS), before


def cycle(spark: SparkSession, sf: str, dim: int, n: int):
    return _cycle(spark, sf, dim, n)


def _columns(dim: int, prefix: str = "con") -> list[str]:
    return [f"{prefix}[{i}] AS v{i}" for i in range(dim + 1)]


def _meshes(dim: int) -> None:
    table, key, error = _SOURCE[dim]
    seed = "WITH " + Q.seed(dim, table, key)
    duck_v = ", ".join(f"CAST(v[{i + 1}] AS INT) AS v{i}" for i in range(dim + 1))

    @query(f"structured_nodes_{dim}d", f"{seed} SELECT id AS node_id, x, y, z FROM nd0")
    def structured_nodes(spark, sf):
        return seed_mesh(spark, sf, dim).nodes

    @query(f"structured_elements_{dim}d", f"{seed} SELECT e AS elem_id, {Q.SHAPE[dim]} AS shape, {duck_v} FROM el0")
    def structured_elements(spark, sf):
        return seed_mesh(spark, sf, dim).elements.selectExpr("elem_id", "shape", *_columns(dim))

    facets = ", ".join("(" + ", ".join(str(j + 1) for j in range(dim + 1) if j != i) + ")" for i in range(dim + 1))
    names = "abc"[:dim]
    facet = "list_sort([" + ", ".join(f"v[{n}]" for n in names) + "])"

    @query(f"facet_counts_{dim}d", f"{seed}, fc AS (SELECT {facet} AS f, count(*) AS n FROM el0, (VALUES {facets}) "
           f"t({', '.join(names)}) GROUP BY 1) SELECT n AS elements, count(*) AS facets FROM fc GROUP BY 1")
    def facet_counts(spark, sf):
        return U.facet_counts(seed_mesh(spark, sf, dim)).groupBy("elements").agg(F.count(F.lit(1)).alias("facets"))

    one, two = (Q.cycles(dim, table, key, error, n) for n in (1, 2))
    before_two = Q.cycles(dim, table, key, error, 1) + ", " + Q.marks(1, Q.LATER_ERROR, 0.15, 0.30) \
        + ", " + Q.closed(dim, 1)

    @query(f"closure_{dim}d", f"{before_two} SELECT e AS elem_id FROM cs1")
    def closure(spark, sf):
        mesh = cycle(spark, sf, dim, 0)[0].refinement.mesh
        return U.closure(mesh, K.mark(later_indicators(mesh), PARAMS.marking).selected)

    @query(f"refine_elements_{dim}d", f"{one} SELECT e AS elem_id, {duck_v} FROM el1")
    def refine_elements(spark, sf):
        return cycle(spark, sf, dim, 0)[0].refinement.mesh.elements.selectExpr("elem_id", *_columns(dim))

    @query(f"adapt_elements_{dim}d", f"{two} SELECT e AS elem_id, {duck_v} FROM el2")
    def adapt_elements(spark, sf):
        return cycle(spark, sf, dim, 1)[0].refinement.mesh.elements.selectExpr("elem_id", *_columns(dim))

    @query(f"adapt_nodes_{dim}d", f"{two} SELECT CAST(id AS INT) AS node_id, x, y, z FROM nd2")
    def adapt_nodes(spark, sf):
        return cycle(spark, sf, dim, 1)[0].refinement.mesh.nodes

    @query(f"hanging_nodes_{dim}d", f"{two} SELECT seq, CAST(node AS INT) AS node, CAST(lo AS INT) AS lo, "
           "CAST(hi AS INT) AS hi, CAST(0.5 AS DOUBLE) AS weight FROM hn2")
    def hanging_nodes(spark, sf):
        return cycle(spark, sf, dim, 1)[0].refinement.mesh.constraints.selectExpr(
            "seq", "node", "parents[0] AS lo", "parents[1] AS hi", "weights[0] AS weight")

    @query(f"prolongation_{dim}d", f"{one}, va AS (SELECT id, (id % 64) * 0.25::DOUBLE AS u FROM nd0) "
           "SELECT CAST(id AS INT) AS node_id, u AS value FROM va UNION ALL "
           "SELECT node, (a.u + b.u) / 2 FROM nw0 JOIN va a ON a.id = lo JOIN va b ON b.id = hi")
    def prolongation(spark, sf):
        result, seed = cycle(spark, sf, dim, 0)
        values = seed.nodes.selectExpr("node_id", "(node_id % 64) * 0.25D AS value")
        return U.prolong(values, result.refinement.prolongation)

    n_kids = S.shape(Q.SHAPE[dim]).children

    @query(f"adapt_summary_{dim}d", f"{two} SELECT 'REFINED' AS status, (SELECT count(*) FROM in1 WHERE f) AS flagged, "
           "(SELECT count(*) FROM mk1) AS marked, (SELECT count(*) FROM sel1) AS selected, "
           "(SELECT count(*) FROM cs1) AS balanced, (SELECT count(*) FROM el2) AS elements, "
           "(SELECT count(*) FROM nd2) AS nodes, (SELECT count(*) FROM hn2) AS hanging, "
           f"CAST({n_kids - 1} * (SELECT count(*) FROM cs1) AS BIGINT) AS grown")
    def adapt_summary(spark, sf):
        a, before = cycle(spark, sf, dim, 1)
        mesh = a.refinement.mesh
        grown = before.elements.join(a.balanced.hint("merge"), "elem_id", "left_semi").agg(
            F.sum(F.expr(element_growth(dim))).alias("grown"), F.count(F.lit(1)).alias("balanced"))
        counts = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in (
            ("elements", mesh.elements), ("nodes", mesh.nodes), ("hanging", mesh.constraints))]
        out = grown
        for c in counts:
            out = out.crossJoin(c)
        return out.select(F.lit(a.status.name).alias("status"), *[
            F.lit(a.marking.metrics[k]).cast("bigint").alias(k) for k in ("flagged", "marked", "selected")],
            "balanced", "elements", "nodes", "hanging", "grown")

    empty = "SELECT CAST(NULL AS VARCHAR) AS violation, CAST(NULL AS BIGINT) AS rows WHERE false"

    @query(f"mesh_violations_{dim}d", empty)
    def mesh_violations(spark, sf):
        return U.violations(cycle(spark, sf, dim, 1)[0].refinement.mesh)

    @query(f"irregular_constraints_{dim}d", f"{two} SELECT h.seq, CAST(h.node AS INT) AS node FROM hn2 h WHERE h.lo IN "
           "(SELECT node FROM hn2) OR h.hi IN (SELECT node FROM hn2)")
    def irregular(spark, sf):
        return U.irregular_constraints(cycle(spark, sf, dim, 1)[0].refinement.mesh)

    @query(f"unlisted_hanging_{dim}d", f"{two}, eg AS (SELECT DISTINCT lo, hi FROM eh2), "
           "md AS (SELECT lo, hi, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM eg "
           "JOIN nd2 a ON a.id = lo JOIN nd2 b ON b.id = hi) SELECT CAST(n.id AS INT) AS node_id, CAST(md.lo AS INT) AS lo, "
           "CAST(md.hi AS INT) AS hi FROM md JOIN nd2 n USING (x, y, z) WHERE NOT EXISTS "
           "(SELECT 1 FROM hn2 h WHERE h.node = n.id AND h.lo = md.lo AND h.hi = md.hi)")
    def unlisted(spark, sf):
        return U.unlisted_hanging(cycle(spark, sf, dim, 1)[0].refinement.mesh)

    @query(f"smx2_roundtrip_{dim}d", f"{one} SELECT e AS elem_id, {Q.SHAPE[dim]} AS shape, {duck_v} FROM el1")
    def smx2_roundtrip(spark, sf):
        path = new_path(spark, "mesh").removeprefix("file:")
        _make_parent(path)
        write_smx2(path, cycle(spark, sf, dim, 0)[0].refinement.mesh)
        return read_smx2(spark, path).mesh.elements.selectExpr("elem_id", "shape", *_columns(dim))

    total = ("abs(" + _edge_determinant(dim) + f") / {2 if dim == 2 else 6}")

    @query(f"total_measure_{dim}d", f"{two}, ms AS (SELECT {total} AS m FROM el2 "
           + " ".join(f"JOIN nd2 n{i} ON n{i}.id = v[{i + 1}]" for i in range(dim + 1))
           + ") SELECT count(*) AS elements, round(sum(m), 6) AS measure, round(min(m), 9) AS smallest FROM ms")
    def total_measure(spark, sf):
        mesh = cycle(spark, sf, dim, 1)[0].refinement.mesh
        rows = geo.with_measures(U.with_positions(mesh.elements, mesh.nodes, dim), dim)
        return rows.selectExpr("count(1) AS elements", "round(sum(measure), 6) AS measure",
                               "round(min(measure), 9) AS smallest")


def _edge_determinant(dim: int) -> str:
    """Determinant of the edges of the simplex on ``n0, n1, ...``."""
    e = [[f"(n{i}.{c} - n0.{c})" for c in "xyz"[:dim]] for i in range(1, dim + 1)]
    if dim == 2:
        return f"({e[0][0]} * {e[1][1]} - {e[0][1]} * {e[1][0]})"
    (a, b, c), (d, f, g), (h, i, j) = e
    return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({d} * {j} - {g} * {h}) + {c} * ({d} * {i} - {f} * {h}))"


_meshes(2)
_meshes(3)

_CENTRE = f"{MESH_COLUMNS / 2}"
_WIDTH2 = f"{(MESH_COLUMNS / 6) ** 2!r}"


@query("bump_indicator", "WITH " + Q.seed(2, *_SOURCE[2][:2])
       + ", ce AS (SELECT e, avg(n.x) AS x, avg(n.y) AS y FROM (SELECT e, unnest(v) AS id FROM el0) JOIN nd0 n USING (id) GROUP BY e), "
       f"er AS (SELECT e, exp(-(pow(x - {_CENTRE}, 2) + pow(y - {_CENTRE}, 2)) / {_WIDTH2}) AS err FROM ce) "
       "SELECT e AS elem_id, round(err, 9) AS error, CAST(CASE WHEN err > 0.05 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS ratio FROM er")
def bump(spark, sf):
    mesh = seed_mesh(spark, sf, 2)
    rows = bump_indicator(mesh.elements, mesh.nodes, (MESH_COLUMNS / 2, MESH_COLUMNS / 2, 0), MESH_COLUMNS / 6)
    return rows.selectExpr("elem_id", "round(error, 9) AS error", "ratio")
