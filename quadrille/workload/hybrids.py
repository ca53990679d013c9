"""Queries over meshes of every shape, and over meshes that rows of a table have broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import conformity as C
from quadrille.operators import hybrid as H
from quadrille.operators import marking as K
from quadrille.operators import mesh as U
from quadrille.operators.adapt import AdaptParams, adapt
from quadrille.workload import hybrid_sql as Q
from quadrille.workload.registry import query

# One box for each customer; one column of four boxes for each supplier.  The row's nation picks the kind, its balance what is refined.
_ROWS = {2: ("customer", "c_custkey", 40, "CAST(c_nationkey % 3 AS INT)", "CAST(round(abs(c_acctbal) * 100) AS BIGINT)"),
         3: ("supplier", "s_suppkey", 10, "CAST(s_nationkey % 2 AS INT)", "CAST(round(abs(s_acctbal) * 100) AS BIGINT)")}
_RULES = ["(val + e) % 4 = 0", "({val} + e) % 5 = 0"]
_CYCLES = 2


def _rules(duck: bool) -> list[str]:
    return [r.replace("{val}", "val // 7" if duck else "val DIV 7") for r in _RULES]


def rows(spark: SparkSession, sf: str, dim: int) -> DataFrame:
    table, key, across, kind, value = _ROWS[dim]
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(
        f"CAST({key} DIV {across} AS BIGINT) AS i", f"CAST({key} % {across} AS BIGINT) AS j", f"{kind} AS kind", f"{value} AS val")


def _duck_rows(dim: int) -> str:
    table, key, across, kind, value = _ROWS[dim]
    one = f"SELECT {key} // {across} AS i, {key} % {across} AS j, {kind} AS kind, {value} AS val FROM {table}"
    if dim == 2:
        return f"SELECT i, j, 0 AS k, kind, val FROM ({one})"
    return f"SELECT i, j, k, CASE WHEN k = 0 THEN kind ELSE k + 1 END AS kind, val FROM ({one}), range(4) r(k)"


def seed(spark: SparkSession, sf: str, dim: int) -> U.Mesh:
    boxes = rows(spark, sf, dim)
    return H.hybrid(boxes if dim == 2 else H.layered(boxes), dim)


def chosen(spark: SparkSession, sf: str, mesh: U.Mesh, rule: str) -> DataFrame:
    """Elements for which ``rule`` over the number ``e`` and their row's ``val`` holds."""
    return H.box_of(mesh).join(rows(spark, sf, mesh.dim).hint("merge"), ["i", "j"]).withColumn("e", F.col("elem_id")).filter(rule).select("elem_id")


def refined(spark: SparkSession, sf: str, dim: int, n: int) -> U.Mesh:
    mesh = seed(spark, sf, dim)
    for rule in _rules(False)[:n]:
        mesh = U.refine(mesh, U.closure(mesh, chosen(spark, sf, mesh, rule))).mesh
    return mesh


def _columns(dim: int, duck: bool) -> str:
    n = 4 if dim == 2 else 8
    return ", ".join(f"v[{i + 1}] AS v{i}" if duck else f"get(con, {i}) AS v{i}" for i in range(n))


def _register(dim: int) -> None:
    start, one, two = (Q.cycles(dim, _duck_rows(dim), _rules(True)[:n]) for n in range(3))
    spark_columns = [c.strip() for c in _columns(dim, False).replace("get(con, ", "get(con,").split(", ")]

    @query(f"hybrid_seed_nodes_{dim}d", f"{start} SELECT id AS node_id, x, y, z FROM nd0")
    def seed_nodes(spark, sf):
        return seed(spark, sf, dim).nodes

    @query(f"hybrid_seed_elements_{dim}d", f"{start} SELECT e AS elem_id, s AS shape, {_columns(dim, True)} FROM el0")
    def seed_elements(spark, sf):
        return seed(spark, sf, dim).elements.selectExpr("elem_id", "shape", *spark_columns)

    @query(f"hybrid_closure_{dim}d", f"{one}, {Q.picked(dim, 1, _rules(True)[1])}, {Q.closed(1)} SELECT e AS elem_id, s AS shape FROM cs1 JOIN el1 USING (e)")
    def closure(spark, sf):
        mesh = refined(spark, sf, dim, 1)
        return U.closure(mesh, chosen(spark, sf, mesh, _rules(False)[1])).join(mesh.elements, "elem_id").select("elem_id", "shape")

    @query(f"hybrid_elements_{dim}d", f"{two} SELECT e AS elem_id, s AS shape, {_columns(dim, True)} FROM el2")
    def elements(spark, sf):
        return refined(spark, sf, dim, _CYCLES).elements.selectExpr("elem_id", "shape", *spark_columns)

    @query(f"hybrid_nodes_{dim}d", f"{two} SELECT id AS node_id, x, y, z FROM nd2")
    def nodes(spark, sf):
        return refined(spark, sf, dim, _CYCLES).nodes

    @query(f"hybrid_hanging_{dim}d", f"{two} SELECT seq, node, len(ps) AS n_parents, ps[1] AS p0, ps[2] AS p1, ps[3] AS p2, ps[4] AS p3, "
           "1.0::DOUBLE / len(ps) AS weight FROM hn2")
    def hanging(spark, sf):
        return refined(spark, sf, dim, _CYCLES).constraints.selectExpr(
            "seq", "node", "CAST(size(parents) AS BIGINT) AS n_parents", *[f"get(array_sort(parents), {k}) AS p{k}" for k in range(4)], "weights[0] AS weight")

    one_broken = f"{one}, {Q.broken(dim, 1, _MORE)}"

    @query(f"conformity_faults_{dim}d", f"{one_broken}, {Q.faults(dim)}")
    def faults(spark, sf):
        return C.faults(broken(spark, sf, dim))

    @query(f"conformity_coverage_{dim}d", f"{one_broken}, {Q.covered(dim, _duck_points(dim))}")
    def coverage(spark, sf):
        points = rows(spark, sf, dim).selectExpr("*", f"explode(sequence(0, {_PER_ROW - 1})) AS t").selectExpr(*_point(dim))
        return C.coverage(broken(spark, sf, dim), points)


# --- meshes broken by rows ---------------------------------------------------------------

_MORE, _PER_ROW = 100_000_000, 20


def _point(dim: int) -> list[str]:
    """Points inside the boxes of rows, none on a lattice plane."""
    across = _ROWS[dim][2]
    axis = "{base} + {size} * (CAST(((val + 17 * t) * {by}) % {over} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / {over} AS {name}"
    return [f"(i * {across} + j) * {_PER_ROW} + t AS pid", axis.format(base="2 * i", size=2, by=7919, over=9973, name="x"),
            axis.format(base="2 * j", size=2, by=104729, over=9967, name="y"),
            axis.format(base="0", size=8, by=31337, over=9949, name="z") if dim == 3 else "CAST(0 AS DOUBLE) AS z"]


def _duck_points(dim: int) -> str:
    table, key, across, _, value = _ROWS[dim]
    return (f"SELECT {', '.join(_point(dim))} FROM (SELECT {key} // {across} AS i, {key} % {across} AS j, {value} AS val FROM {table}), "
            f"range({_PER_ROW}) g(t)")


def broken(spark: SparkSession, sf: str, dim: int) -> U.Mesh:
    """A refined mesh of which rows take, double or turn elements, double nodes, and take or change constraints."""
    mesh = refined(spark, sf, dim, 1)
    values = rows(spark, sf, dim).select("i", "j", "val")
    tall = {2: "true", 3: "z < 8"}[dim]  # positions above the last layer are in no box
    nodes = mesh.nodes.selectExpr("*", f"IF({tall}, floor(x / 2), NULL) AS i", "floor(y / 2) AS j").join(values.hint("merge"), ["i", "j"], "left")
    doubled = nodes.filter("(val + node_id) % 40 = 0").selectExpr(f"node_id + {_MORE} AS node_id", "x", "y", "z")
    boxed = H.box_of(mesh).join(values.hint("merge"), ["i", "j"]).select("elem_id", "val").join(mesh.elements.hint("merge"), "elem_id")
    turned = boxed.filter("(val + elem_id) % 6 <> 1").selectExpr(
        "elem_id", "shape", "IF(shape IN (0, 4) AND (val + elem_id) % 6 = 0, concat(array(con[1], con[0]), slice(con, 3, size(con) - 2)), con) AS con")
    again = boxed.filter("(val + elem_id) % 6 = 2").selectExpr(f"elem_id + {_MORE} AS elem_id", "shape", "con")
    hanging = mesh.constraints.join(nodes.select(F.col("node_id").alias("node"), "val").hint("merge"), "node")
    changed = hanging.filter("coalesce((val + node) % 5, 9) <> 0").selectExpr(
        "seq", "node", "parents", "IF(coalesce((val + node) % 5, 9) <> 1, weights, transform(weights, (w, n) -> "
        "w + CASE n WHEN 0 THEN 0.125D WHEN 1 THEN -0.125D ELSE 0D END)) AS weights")
    return U.Mesh(dim, nodes.select("node_id", "x", "y", "z").unionByName(doubled), turned.unionByName(again), changed).staged()


# --- one cycle that ends in each way ---------------------------------------------------------

_ERROR, _FLAG = "CAST((val + e * 31) % 1000 AS {double})", "(val + e) % 10 < {share}"
#: Share of flagged elements in tenths, theta, beta, room to grow in hundredths of the elements, size floor, least growth.
_OUTCOMES = {"REFINED": (3, 0.05, 0.3, 0, 0.0, 0.0), "STAGNATED": (3, 0.02, 0.02, 0, 0.0, 0.9), "NO_CANDIDATES": (0, 0.3, 0.3, 0, 0.0, 0.0),
             "FLOOR_EXHAUSTED": (3, 0.3, 0.3, 0, 5.0, 0.0), "ELEMENT_CEILING": (3, 0.3, 0.3, -1, 0.0, 0.0), "FLOORED": (5, 0.2, 0.3, 30, 0.65, 0.0)}


def _adapted(spark: SparkSession, sf: str, dim: int, mesh: U.Mesh, share: int, theta: float, beta: float, room: int, floor: float, least: float):
    boxed = H.box_of(mesh).join(rows(spark, sf, dim), ["i", "j"]).withColumn("e", F.col("elem_id"))
    given = boxed.selectExpr("elem_id", _ERROR.format(double="DOUBLE") + " AS error", f"IF({_FLAG.format(share=share)}, 1.5D, 0.5D) AS ratio")
    n = mesh.elements.count()
    ceiling = 0 if room == 0 else n + 1 if room < 0 else n + room * n // 100
    return adapt(mesh, given, AdaptParams(K.Params(theta, beta, floor, ceiling), least))


def _cycle_sql(dim: int, share: int, theta: float, beta: float, room: int, floor: float) -> str:
    limit = "1000000000000000" if room == 0 else "1" if room < 0 else f"({room} * (SELECT count(*) FROM el1) // 100)"
    return Q.asks(1) + ", " + Q.within(dim, 1, _ERROR.format(double="BIGINT"), _FLAG.format(share=share), theta, beta, limit, floor)


def _register_cycles(dim: int) -> None:
    start = Q.cycles(dim, _duck_rows(dim), _rules(True)[:1])
    bound = (3, 0.2, 0.3, 10, 0.0, 0.0)

    @query(f"adapt_ceiling_{dim}d", f"{start}, {_cycle_sql(dim, *bound[:5])} SELECT e AS elem_id, chosen FROM fit")
    def ceiling(spark, sf):
        a = _adapted(spark, sf, dim, refined(spark, sf, dim, 1), *bound)
        chosen = a.selected.select("elem_id", F.lit(True).alias("chosen"))
        return a.balanced.join(chosen, "elem_id", "left").select("elem_id", F.coalesce("chosen", F.lit(False)).alias("chosen"))

    for outcome, facts in _OUTCOMES.items():
        if dim == 3 and outcome not in ("ELEMENT_CEILING", "FLOORED"):
            continue  # the same code without a dimension of its own
        _register_outcome(dim, start, outcome, facts)


def _register_outcome(dim: int, start: str, outcome: str, facts: tuple) -> None:
    added = "coalesce((SELECT sum(growth) FROM fit JOIN ie USING (e)), 0)"
    status = (f"CASE WHEN NOT EXISTS (FROM fg) THEN 'NO_CANDIDATES' WHEN NOT EXISTS (FROM cd) THEN 'FLOOR_EXHAUSTED' WHEN NOT EXISTS (FROM fit) THEN 'ELEMENT_CEILING' "
              f"WHEN {added} < {facts[5]} * (SELECT count(*) FROM el1) THEN 'STAGNATED' ELSE 'REFINED' END")

    @query(f"adapt_{outcome.lower()}_{dim}d", f"{start}, {_cycle_sql(dim, *facts[:5])} SELECT {status} AS status, (SELECT count(*) FROM fg) AS flagged, "
           f"(SELECT count(*) FROM fit WHERE chosen) AS selected, (SELECT count(*) FROM fit) AS balanced, (SELECT count(*) FROM el1) + {added} AS elements")
    def ended(spark, sf):
        mesh = refined(spark, sf, dim, 1)
        a = _adapted(spark, sf, dim, mesh, *facts)
        after = a.refinement.mesh.elements if a.refinement else mesh.elements
        counts = [t.agg(F.count(F.lit(1)).alias(name)) for name, t in
                  (("flagged", a.marking.flagged), ("selected", a.selected), ("balanced", a.balanced if a.balanced is not None else a.selected.limit(0)), ("elements", after))]
        result = counts[0]
        for one in counts[1:]:
            result = result.crossJoin(one)  # single rows
        return result.select(F.lit(a.status.name).alias("status"), "flagged", "selected", "balanced", "elements")


for _dim in (2, 3):
    _register(_dim)
    _register_cycles(_dim)
