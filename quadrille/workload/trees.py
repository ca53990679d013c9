"""Tree queries: codes, refinement, coarsening, balance, joins, invariants."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quadrille.functions import morton as M
from quadrille.operators import balance as B
from quadrille.operators import locate as L
from quadrille.operators import oracles as O
from quadrille.operators import partitions as X
from quadrille.operators import tree as T
from quadrille.operators.points import tree_of_measures
from quadrille.operators.verify import verify_report
from quadrille.plans.prefix import row_index, running_sum
from quadrille.plans.staging import new_path, stage
from quadrille.sources.amr1 import read_amr1, write_amr1
from quadrille.sources.export import svg_cells, vtk_points
from quadrille.workload import tree_sql as S
from quadrille.workload.inputs import EVENTS, LINES, LINES_3D, VECTORS, Points
from quadrille.workload.registry import query

G2, G3, GE, GV = LINES.grid, LINES_3D.grid, EVENTS.grid, VECTORS.grid
LEAVES = " SELECT code, level FROM leaves"


# --- codes --------------------------------------------------------------------


def _encode(name: str, p: Points) -> None:
    xyz = ", ".join(p.grid.axes)
    pts_enc = S.enc(p.grid, level=None)

    @query(f"morton_encode_{name}", f"WITH pts AS ({p.duck}) SELECT pid, {xyz}, {pts_enc} AS code FROM pts")
    def encode(spark, sf):
        return p.load(spark, sf).select("pid", *p.grid.axes, "code")

    back = ", ".join(
        f"CAST(list_sum(list_transform(range({p.grid.max_level}), lambda i: "
        f"((code >> ({p.grid.dim} * i + {k})) & 1) << i)) AS BIGINT) AS {a}"
        for k, a in enumerate(p.grid.axes))
    mixed = f"(l_orderkey * 40503 + l_partkey * 977) % {1 << p.grid.bits}"

    @query(f"morton_decode_{name}",
           f"WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS pid, {mixed} AS code FROM lineitem) "
           f"SELECT pid, code, {back} FROM c")
    def decode(spark, sf):
        codes = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
            "l_orderkey * 8 + l_linenumber AS pid", f"{mixed} AS code")
        return codes.selectExpr("pid", "code", *[
            f"{c} AS {a}" for a, c in zip(p.grid.axes, M.decode("code", p.grid.dim, p.grid.max_level))])

    @query(f"neighbour_codes_{name}", S.tree(p) + ", " + S.neighbours(p.grid)
           + " SELECT lcode AS code, level, CAST(dir AS INT) AS dir, n_code FROM nb")
    def neighbour_codes(spark, sf):
        return L.neighbour_cells(p.tree(spark, sf), p.grid)

    dim, top = p.grid.dim, p.grid.max_level
    half = S._xyz(p.grid, "({a} & ~1) AS {a}")
    index = " + ".join(f"({a} & 1) * {1 << k}" for k, a in enumerate(p.grid.axes))

    @query(f"cell_geometry_{name}", S.tree(p)
           + f", fam AS (SELECT level, code, {half} FROM leaves WHERE level > 0), "
           f"par AS (SELECT code, {S.enc(p.grid)} AS parent FROM fam) "
           f"SELECT l.code, l.level, par.parent, CAST({index} AS INT) AS child_index, "
           f"{S.end(p.grid)} AS last_code, pow(2.0, -{dim} * l.level) AS volume, "
           f"{S._xyz(p.grid, 'l.{a} << (' + str(top) + ' - l.level) AS {a}')} "
           "FROM leaves l JOIN par ON par.code = l.code")
    def cell_geometry(spark, sf):
        cells = T.cell_columns(p.tree(spark, sf).filter("level > 0"), p.grid)
        return cells.selectExpr(
            "code", "level", f"{M.ancestor('code', 'level - 1', p.grid)} AS parent",
            f"{M.child_index('code', 'level', p.grid)} AS child_index", "last_code", "volume", *p.grid.axes)


_encode("2d", LINES)
_encode("3d", LINES_3D)


# --- trees from points, refinement, coarsening ----------------------------------


def _tree(name: str, p: Points) -> None:
    @query(f"points_tree_{name}", S.tree(p) + LEAVES)
    def points_tree(spark, sf):
        return p.tree(spark, sf)

    @query(f"level_histogram_{name}",
           S.tree(p) + " SELECT level, count(*) AS leaves FROM leaves GROUP BY level")
    def histogram(spark, sf):
        return T.level_histogram(p.tree(spark, sf))

    @query(f"tree_summary_{name}",
           S.tree(p) + f" SELECT count(*) AS leaves, min(level) AS min_level, max(level) AS max_level, "
           f"sum(pow(2.0, -{p.grid.dim} * level)) AS volume FROM leaves")
    def summary(spark, sf):
        return T.summary(p.tree(spark, sf), p.grid)

    internal = S._xyz(p.grid, "{a}")

    @query(f"split_cells_{name}",
           "WITH " + S.crowded(p) + f", c AS (SELECT level, {internal} FROM split0) "
           f"SELECT {S.enc(p.grid)} AS code, level FROM c")
    def split_cells(spark, sf):
        return T.internal_of(p.tree(spark, sf), p.grid)

    @query(f"verify_{name}", S.tree(p, balance=True) + f", o AS (SELECT code, {S.end(p.grid)} AS last, level, "
           f"max({S.end(p.grid)}) OVER (ORDER BY code, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
           "AS before FROM leaves l) SELECT count(*) AS leaves, "
           f"count(*) FILTER (level < 0 OR level > {p.grid.max_level}) AS out_of_range, "
           f"count(*) FILTER ((last - code) & code <> 0) AS misaligned, "
           f"count(*) FILTER (code < 0 OR last > {p.grid.last_code}) AS outside, "
           "count(*) FILTER (code <= before) AS overlaps, "
           f"sum(pow(2.0, -{p.grid.dim} * level)) AS volume FROM o")
    def verify(spark, sf):
        return verify_report(B.balance(p.tree(spark, sf), p.grid), p.grid)


_tree("2d", EVENTS)
_tree("lines", LINES)
_tree("3d", VECTORS)
_tree("lines_3d", LINES_3D)


def _band_sql(p: Points, cfg: O.Config, t: str) -> str:
    """The band predicate on cell coordinates of table ``t``."""
    g = p.grid
    size = f"(1 << ({g.max_level} - {t}.level))"
    dist = " + ".join(f"pow(({t}.{a} + 0.5::DOUBLE) * {size} - {c}, 2)"
                      for a, c in zip(g.axes, cfg.int_center(g.dim)))
    reach = f"({cfg.bandwidth * g.width}::DOUBLE + {size}::DOUBLE * {math.sqrt(g.dim) / 2!r}::DOUBLE)"
    r = f"{cfg.radius * g.width}::DOUBLE"
    return (f"({t}.level < {cfg.coarse_level} OR ({t}.level < {cfg.fine_level} AND {dist} < pow({r} + {reach}, 2) "
            f"AND ({r} - {reach} <= 0 OR {dist} > pow({r} - {reach}, 2))))")


def _refine(name: str, p: Points, cfg: O.Config) -> None:
    g = p.grid
    bits = ", ".join(f"(VALUES (0), (1)) AS bit_{a}(o{a})" for a in g.axes)
    split = f"({_band_sql(p, cfg, 'c')} AND c.level < {g.max_level})"
    step = (f"SELECT c.level + 1, {S._xyz(g, '2 * c.{a} + o{a}')} FROM {{src}} c, {bits} WHERE {split}")
    xyz = S._xyz(g, "{a}")

    @query(f"refine_once_{name}", S.tree(p) + f", nxt AS (SELECT level, {xyz} FROM leaves c WHERE NOT {split} "
           f"UNION ALL {step.format(src='leaves')}) SELECT {S.enc(g)} AS code, level FROM nxt")
    def once(spark, sf):
        return T.refine(p.tree(spark, sf), g, O.band(cfg))

    @query(f"refine_converge_{name}", S.tree(p) + f", grow AS (SELECT level, {xyz} FROM leaves UNION ALL "
           f"{step.format(src='grow')}) SELECT {S.enc(g)} AS code, level FROM grow c WHERE NOT {split}")
    def converge(spark, sf):
        return T.refine_converge(p.tree(spark, sf), g, O.band(cfg))

    up = S._xyz(g, "{a} >> 1 AS {a}")
    parent_band = _band_sql(p, cfg, "m")
    same = " AND ".join(f"m.{a} = l.{a} >> 1" for a in g.axes)

    @query(f"coarsen_once_{name}", S.tree(p) + f", m AS (SELECT level - 1 AS level, {up} FROM leaves WHERE level > 0 "
           f"GROUP BY ALL HAVING count(*) = {g.children}), gone AS (SELECT * FROM m WHERE NOT {parent_band}) "
           f"SELECT {S.enc(g)} AS code, CAST(level AS INT) AS level FROM gone UNION ALL "
           f"SELECT code, level FROM leaves l WHERE NOT EXISTS (SELECT 1 FROM gone m WHERE m.level = l.level - 1 AND {same})")
    def coarsen(spark, sf):
        return T.coarsen(p.tree(spark, sf), g, O.band(cfg))


_refine("2d", LINES, O.Config(12, 0.3, 0.02, coarse_level=4, fine_level=9))
_refine("3d", VECTORS, O.Config(8, 0.3, 0.05, coarse_level=2, fine_level=5))

_HASH = f"((code::HUGEINT * {O.HASH_MULTIPLIER}) % {1 << 64})"
_MID = GE.width // 2


def _holds(axes) -> str:
    return " AND ".join(f"{a} << ({GE.max_level} - level) <= {_MID} AND "
                        f"({a} + 1) << ({GE.max_level} - level) > {_MID}" for a in axes)


@query("oracle_flags", S.tree(EVENTS)
       + f" SELECT code, level, {_holds('xy')} AS tower, ({_holds('x')} AND level < 9) AS crack, "
       f"(level < 9 AND (code % 7 = 0 OR code % 13 = 0)) AS cloud, (level < 9 AND {_HASH} % 3 = 0) AS third, "
       f"(level < 9 AND ({_HASH} // {1 << 40}) % 4 = 0) AS quarter, "
       "(level = 0 OR (level = 1 AND x & 1 = 1 AND y & 1 = 1)) AS graded FROM leaves l")
def oracle_flags(spark, sf):
    rules = {"tower": O.tower(), "crack": O.crack(9), "cloud": O.cloud(9), "third": O.hash_third(9),
             "quarter": O.hash_quarter(9), "graded": O.graded()}
    cells = T.with_corner(EVENTS.tree(spark, sf), GE)
    return cells.select("code", "level", *[o.splits(GE).alias(n) for n, o in rules.items()])


# --- balance ------------------------------------------------------------------


def _balance(name: str, p: Points) -> None:
    g = p.grid

    @query(f"balance_{name}", S.tree(p, balance=True) + LEAVES)
    def sweep(spark, sf):
        return B.balance(p.tree(spark, sf), g)

    @query(f"balance_by_level_{name}", S.tree(p, balance=True) + LEAVES)
    def by_level(spark, sf):
        return B.balance(stage(p.tree(spark, sf)), g, chain_rows=64)

    @query(f"balance_passes_{name}", S.tree(p, balance=True) + LEAVES)
    def ripple(spark, sf):
        return B.balance_passes(stage(p.tree(spark, sf)), g).leaves

    @query(f"balance_region_{name}", S.tree(p, region=True) + LEAVES)
    def region(spark, sf):
        return B.balance(p.tree(spark, sf), g, rule="region")

    found = " SELECT code, level, count(*) AS violations FROM bad GROUP BY code, level"

    @query(f"violations_before_{name}", S.tree(p) + ", " + S.too_coarse(g) + found)
    def before(spark, sf):
        return B.violations(stage(p.tree(spark, sf)), g)

    @query(f"violations_after_{name}", S.tree(p, balance=True) + ", " + S.too_coarse(g) + found)
    def after(spark, sf):
        return B.violations(stage(B.balance(p.tree(spark, sf), g)), g)


_balance("2d", EVENTS)
_balance("3d", VECTORS)


def _front(name: str, p: Points) -> None:
    g = p.grid
    last = "(SELECT max(pass) FROM rip)"

    @query(f"balance_front_{name}", S.tree(p) + ", " + S.ripple(g) + f" SELECT {S.enc(g)} AS code, level, {last} AS passes FROM rip WHERE pass = {last}")
    def front(spark, sf):
        done = B.balance_passes(stage(p.tree(spark, sf)), g)
        return done.leaves.withColumn("passes", F.lit(done.passes))


_front("2d", EVENTS)
_front("3d", VECTORS)
_front("lines", LINES)


@query("balance_parity", "SELECT true AS same")
def balance_parity(spark, sf):
    tree = stage(EVENTS.tree(spark, sf))
    a = B.balance(tree, GE).selectExpr("code", "level", "1 AS d")
    b = B.balance_passes(tree, GE).leaves.selectExpr("code", "level", "-1 AS d")
    return a.unionByName(b).groupBy("code", "level").agg(F.sum("d").alias("d")) \
        .agg((F.count(F.when(F.col("d") != 0, 1)) == 0).alias("same"))


@query("balance_histogram_lines",
       S.tree(LINES, balance=True) + " SELECT level, count(*) AS leaves FROM leaves GROUP BY level")
def balance_histogram_lines(spark, sf):
    return T.level_histogram(B.balance(LINES.tree(spark, sf), G2))


# --- trees that follow sums of a table's values -----------------------------------


def _measures(name: str, p: Points, rule: str) -> None:
    # The signed sum may be small where that of a part is large, so cells below one that does not split must not.
    signed = "w * 7919 % 2001 - 1000"

    @query(f"refine_measure_{name}", S.measured(p, f"sum({signed}) AS total, max(w) AS top, count(*) AS n", rule) + LEAVES)
    def measured(spark, sf):
        measures = {"total": ("sum", signed), "top": ("max", "w"), "n": ("sum", "1")}
        return tree_of_measures(p.load(spark, sf), p.grid, measures, rule)


_measures("2d", EVENTS, "n > 2 AND abs(total) + top % 7 > 40 * level")
_measures("3d", VECTORS, "n > 1 AND (abs(total) > 300 OR top % 5 = 0)")
_measures("lines", LINES, "n > 8 AND abs(total) > 500")


# --- joins between cells --------------------------------------------------------


def _joins(name: str, p: Points) -> None:
    g = p.grid
    pts = f"SELECT pid, w, {S.enc(g, level=None)} AS code FROM pts"
    located = S.tree(p, balance=True) + f", pc AS ({pts})"
    match = f"p.code BETWEEN l.code AND {S.end(g)}"

    @query(f"point_location_{name}", located + " SELECT p.pid, p.code, l.code AS leaf_code, "
           f"l.level AS leaf_level FROM pc p JOIN leaves l ON {match}")
    def point_location(spark, sf):
        leaves = stage(B.balance(p.tree(spark, sf), g))
        return L.locate(p.load(spark, sf).select("pid", "code"), leaves, g)

    @query(f"leaf_aggregate_{name}", located + " SELECT l.code AS leaf_code, l.level AS leaf_level, "
           "count(*) AS points, CAST(sum(p.w) AS BIGINT) AS total, max(p.w) AS worst "
           f"FROM pc p JOIN leaves l ON {match} GROUP BY 1, 2")
    def leaf_aggregate(spark, sf):
        leaves = stage(B.balance(p.tree(spark, sf), g))
        return L.aggregate_by_leaf(p.load(spark, sf), leaves, g, F.count(F.lit(1)).alias("points"),
                                   F.sum("w").alias("total"), F.max("w").alias("worst"))

    overlap = f"l.code <= nb.n_end AND {S.end(g)} >= nb.n_code"

    @query(f"neighbour_levels_{name}", S.tree(p) + ", " + S.neighbours(g)
           + " SELECT nb.lcode AS code, nb.level, CAST(nb.dir AS INT) AS dir, max(l.level) AS max_level "
           f"FROM nb JOIN leaves l ON {overlap} GROUP BY 1, 2, 3")
    def neighbour_levels(spark, sf):
        return L.neighbour_levels(stage(p.tree(spark, sf)), g)

    inside = f"l.code >= nb.n_code AND {S.end(g)} <= nb.n_end"

    @query(f"region_leaves_{name}",
           S.tree(p) + ", " + S.neighbours(g)
           + f" SELECT DISTINCT l.code, l.level FROM leaves l JOIN nb ON {inside}")
    def region_leaves(spark, sf):
        leaves = stage(p.tree(spark, sf))
        return L.covered_by_regions(leaves, leaves, g)


_joins("2d", EVENTS)
_joins("3d", VECTORS)


@query("exact_lookup", S.tree(LINES) + f", pc AS (SELECT DISTINCT {S.enc(G2, level=None)} AS code, "
       f"{G2.max_level} AS level FROM pts) SELECT pc.code, pc.level, l.code IS NOT NULL AS is_leaf "
       "FROM pc LEFT JOIN leaves l ON l.code = pc.code AND l.level = pc.level")
def exact_lookup(spark, sf):
    cells = LINES.load(spark, sf).selectExpr("code", f"{G2.max_level} AS level").distinct()
    found = LINES.tree(spark, sf).withColumn("is_leaf", F.lit(True))
    return cells.join(found, ["code", "level"], "left").withColumn(
        "is_leaf", F.coalesce("is_leaf", F.lit(False)))


# --- prefixes and partitions ------------------------------------------------------

PARTS = 7
_RANKED = (", r AS (SELECT code, level, x, y, row_number() OVER (ORDER BY code) - 1 AS i, "
           "count(*) OVER () AS n FROM leaves), "
           f"own AS (SELECT code, level, x, y, i, CAST(CASE WHEN i < (n % {PARTS}) * (n // {PARTS} + 1) "
           f"THEN i // (n // {PARTS} + 1) ELSE n % {PARTS} + (i - (n % {PARTS}) * (n // {PARTS} + 1)) "
           f"// greatest(n // {PARTS}, 1) END AS INT) AS part FROM r)")
_EV1 = S.tree(EVENTS, balance=True)


def _balanced_events(spark, sf):
    return stage(B.balance(EVENTS.tree(spark, sf), GE))


@query("row_index", _EV1 + _RANKED + " SELECT code, level, i AS row_index FROM own")
def row_index_query(spark, sf):
    return row_index(_balanced_events(spark, sf), ["code"])


@query("exclusive_prefix_sum", S.tree(EVENTS) + " SELECT code, level, "
       "CAST(coalesce(sum(CASE WHEN level < 8 THEN 4 ELSE 1 END) OVER (ORDER BY code ROWS BETWEEN "
       "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row FROM leaves")
def exclusive_prefix_sum(spark, sf):
    """Where each leaf's rows start once the leaves above level 8 are split."""
    rows = EVENTS.tree(spark, sf).withColumn("rows", F.expr("IF(level < 8, 4, 1)"))
    return running_sum(rows, ["code"], "rows", "first_row", exclusive=True).drop("rows")


@query("repartition_counts", _EV1 + _RANKED
       + f" SELECT part, min(code) AS first_code, max({S.end(GE, 'own')}) AS last_code, "
       "count(*) AS leaves FROM own GROUP BY part")
def repartition_counts(spark, sf):
    return X.part_ranges(X.assign_parts(_balanced_events(spark, sf), PARTS), GE)


@query("partition_map", _EV1 + _RANKED + " SELECT part, min(code) AS first_code, count(*) AS leaves "
       "FROM own GROUP BY part")
def partition_map(spark, sf):
    return X.partition_map(X.assign_parts(_balanced_events(spark, sf), PARTS), PARTS)


@query("repartition_physical", _EV1 + _RANKED + " SELECT code, level, part FROM own")
def repartition_physical(spark, sf):
    moved = X.repartition(_balanced_events(spark, sf), PARTS)
    return moved.withColumn("part", F.spark_partition_id())


_GHOST = (_EV1 + _RANKED + ", " + S.neighbours(GE, "own", ", l.part AS part")
          + ", reg AS (SELECT DISTINCT part, n_code, n_end FROM nb) "
          "SELECT DISTINCT reg.part, l.code, l.level, l.part AS owner FROM reg JOIN own l "
          f"ON l.code <= reg.n_end AND {S.end(GE)} >= reg.n_code AND l.part <> reg.part")


@query("ghost_layer", _GHOST)
def ghost_layer(spark, sf):
    return X.ghost_layer(stage(X.assign_parts(_balanced_events(spark, sf), PARTS)), GE)


# --- files and drawings -------------------------------------------------------------


@query("svg_cells", S.tree(EVENTS) + ", b AS (SELECT min(level) AS lo, max(level) AS hi FROM leaves), "
       f"s AS (SELECT *, (1 << ({GE.max_level} - level)) * {1000.0 / GE.width!r} AS side FROM leaves, b) "
       "SELECT code, level, x * side AS x, 1000.0 - y * side - side AS y, side, "
       "CAST(trunc(CASE WHEN hi <= lo THEN 210 ELSE 210.0 - 210.0 * ((level - lo)::DOUBLE / (hi - lo)) END) AS INT) "
       "AS hue FROM s")
def svg(spark, sf):
    return svg_cells(EVENTS.tree(spark, sf), GE)


_VTK = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(
    ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))))


@query("vtk_points", S.tree(VECTORS) + " SELECT code, CAST(k AS INT) AS k, (x + a) * pow(2.0, -level) AS px, "
       f"(y + b) * pow(2.0, -level) AS py, (z + c) * pow(2.0, -level) AS pz FROM leaves, (VALUES {_VTK}) AS v(k, a, b, c)")
def vtk(spark, sf):
    return vtk_points(VECTORS.tree(spark, sf), GV)


@query("amr1_roundtrip", S.tree(VECTORS)
       + " SELECT code, level, code * 0.5 AS half, CAST(CAST(level * 0.25 AS FLOAT) AS DOUBLE) AS quarter FROM leaves")
def amr1_roundtrip(spark, sf):
    path = new_path(spark, "tree").removeprefix("file:")
    _make_parent(path)
    leaves = VECTORS.tree(spark, sf).selectExpr("code", "level", "code * 0.5D AS half", "level * 0.25D AS quarter")
    write_amr1(leaves, path, 3, GV.max_level, float32=("quarter",))
    return read_amr1(spark, path)[1]


def _make_parent(path: str) -> None:
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
