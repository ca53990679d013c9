"""Unstructured meshes of mixed shapes with hanging nodes.

A mesh is three relations

    nodes        node_id INT, x DOUBLE, y DOUBLE, z DOUBLE
    elements     elem_id INT, shape INT, con ARRAY<INT>
    constraints  seq INT, node INT, parents ARRAY<INT>, weights ARRAY<DOUBLE>

with dense ids from 0.  Element and node numbers are part of the result: new
nodes are numbered in order of creation and children in the order of their
parents, so every number comes from an order, never from the data layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.geometry import midpoints, split_choice, split_qualities
from quadrille.operators.shapes import T4, case, of_dim, shapes
from quadrille.plans.prefix import dense_ids
from quadrille.plans.staging import stage_packed as stage

NODES = "node_id INT, x DOUBLE, y DOUBLE, z DOUBLE"
ELEMENTS = "elem_id INT, shape INT, con ARRAY<INT>"
CONSTRAINTS = "seq INT, node INT, parents ARRAY<INT>, weights ARRAY<DOUBLE>"


#: Elements of successive numbers that are handled together.
BUCKET = 1 << 16


class InvalidMesh(ValueError):
    pass


@dataclass(frozen=True)
class Mesh:
    dim: int
    nodes: DataFrame
    elements: DataFrame
    constraints: DataFrame

    def staged(self) -> Mesh:
        """The same mesh, written out and read back."""
        return Mesh(self.dim, stage(self.nodes, "nodes"), stage(self.elements, "elements"),
                    stage(self.constraints, "constraints"))


@dataclass(frozen=True)
class Refinement:
    """A refined mesh and one row per new node: its value is the weighted sum of its parents."""

    mesh: Mesh
    prolongation: DataFrame  # node, parents, weights


def mesh_of(spark: SparkSession, dim: int, nodes: list, elements: list,
            constraints: list = ()) -> Mesh:
    """Mesh literal: points, ``(shape, vertices)`` and ``(node, parents, weights)`` rows."""
    rows = [(i, *map(float, p), *([0.0] * (3 - len(p)))) for i, p in enumerate(nodes)]
    els = [(i, s, list(v)) for i, (s, v) in enumerate(elements)]
    hang = [(i, n, list(p), list(map(float, w))) for i, (n, p, w) in enumerate(constraints)]
    return Mesh(dim, spark.createDataFrame(rows, NODES), spark.createDataFrame(els, ELEMENTS),
                spark.createDataFrame(hang, CONSTRAINTS))


# --- gathering ----------------------------------------------------------------


def with_positions(elements: DataFrame, nodes: DataFrame, dim: int,
                   vertices: int | None = None) -> DataFrame:
    """Add the vertex coordinates ``x0, y0[, z0], x1, ...`` in node order.

    Elements of near numbers share most vertices: a bucket of them gets each of its nodes once, and picks from those.
    An element none of whose vertices is a node is left out.
    """
    n = vertices or max(s.vertices for s in of_dim(dim))
    axes = "xyz"[:dim]
    bucket = f"CAST(elem_id DIV {BUCKET} AS BIGINT)"
    places = nodes.groupBy("node_id").agg(*[F.max(c).alias(c) for c in axes])
    near = elements.selectExpr(f"{bucket} AS _near", "explode(con) AS node_id").distinct().join(places.hint("merge"), "node_id")
    first = ["elem_id", *[c for c in elements.columns if c != "elem_id"]]
    schema = T.StructType([elements.schema[c] for c in first] + [T.StructField(f"{c}{i}", T.DoubleType()) for i in range(n) for c in axes])

    def pick(rows: pa.Table, known: pa.Table) -> pa.Table:
        con = rows["con"].combine_chunks()
        lengths = con.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = con.flatten()
        wanted = values.fill_null(0).to_numpy(zero_copy_only=False)
        ids = known["node_id"].to_numpy()
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)] if len(ids) else np.zeros(len(wanted), np.int64)
        found = values.is_valid().to_numpy(zero_copy_only=False) & (ids[at] == wanted if len(ids) else False)
        starts = np.cumsum(lengths) - lengths
        out, placed = [rows[c] for c in first], np.zeros(len(lengths), bool)
        for i in range(n):
            there = lengths > i
            vertex = np.where(there, starts + i, 0)
            there[there] = found[vertex[there]]
            placed |= there
            source = np.zeros(len(there), np.int64)
            source[there] = at[vertex[there]]
            picks = pa.array(source, mask=~there)
            out += [known[c].combine_chunks().take(picks) for c in axes]
        for i in range(n, int(lengths.max(initial=0))):
            placed[lengths > i] |= found[(starts + i)[lengths > i]]
        return pa.Table.from_arrays(out, names=schema.names).filter(pa.array(placed))

    dealt = elements.withColumn("_bucket", F.expr(bucket)).repartition("_bucket")
    return dealt.groupBy("_bucket").cogroup(near.repartition("_near").groupBy("_near")).applyInArrow(pick, schema)


def incidence(elements: DataFrame) -> DataFrame:
    """One row per (node, element)."""
    return elements.select(F.explode("con").alias("node"), "elem_id")


def _pair(low: str, high: str) -> str:
    """Two node numbers as one."""
    return f"shiftleft(CAST({low} AS BIGINT), 32) | (CAST({high} AS BIGINT) & 4294967295L)"


def _pairs(elements: DataFrame, *keep: str, upto: int | None = None) -> DataFrame:
    """Every ``pair`` of vertices of each element, with the columns ``keep``; those of nodes up to ``upto`` only, if given."""
    few = " ".join(f"WHEN {n} THEN array(" + ", ".join(
        f"IF(con[{i}] < con[{j}], {_pair(f'con[{i}]', f'con[{j}]')}, {_pair(f'con[{j}]', f'con[{i}]')})"
        for i, j in combinations(range(n), 2)) + ")" for n in (3, 4))
    more = f"filter(flatten(transform(con, a -> transform(con, b -> IF(a < b, {_pair('a', 'b')}, NULL)))), p -> p IS NOT NULL)"
    rows = elements.selectExpr(*keep, f"CASE size(con) {few} ELSE {more} END AS pairs").selectExpr(*keep, "explode(pairs) AS pair")
    return rows if upto is None else rows.filter(f"shiftright(shiftleft(pair, 32), 32) <= {upto}L")


def _last_parent(rows: DataFrame) -> int:
    """The highest number among ``parents``: no pair with a later node can be asked for, as those of new children are not."""
    last = rows.agg(F.max(F.array_max("parents"))).first()[0]
    return -1 if last is None else last


def _asked(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", f"{_pair('array_min(parents)', 'array_max(parents)')} AS pair")


def _having_more(rows: DataFrame, elements: DataFrame, keep: list[str], upto: int) -> DataFrame:
    """Elements that have all ``parents`` of a row ``_asked``, which may be more than two."""
    pairs = _pairs(elements, "elem_id", "con", upto=upto)
    return rows.select(*keep, "parents", "pair").join(pairs.hint("merge"), "pair") \
        .filter("forall(parents, v -> array_contains(con, v))").select(*keep, "elem_id")


def elements_having(rows: DataFrame, elements: DataFrame, keep: list[str]) -> DataFrame:
    """Elements that have all ``parents`` of a row as vertices: ``keep`` and ``elem_id``.

    An element lists its vertex pairs; a row looks for its lowest and highest
    parent.  Only where rows have more parents do the elements' other vertices
    come along, to be checked on the match.
    """
    asked, upto = _asked(rows), _last_parent(rows)
    two = asked.filter("size(parents) = 2").select(*keep, "pair").join(_pairs(elements, "elem_id", upto=upto).hint("merge"), "pair") \
        .select(*keep, "elem_id")
    more = asked.filter("size(parents) > 2")
    return two if more.isEmpty() else two.unionByName(_having_more(more, elements, keep, upto))


def had_by_any(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows (node, parents, ...) all of whose parents are vertices of one element.

    Elements that lie together share most of their pairs, so the distinct ones
    are few once they are combined where they are read.
    """
    asked, upto = _asked(rows), _last_parent(rows)
    two = asked.filter("size(parents) = 2").join(_pairs(elements, upto=upto).distinct().hint("merge"), "pair", "left_semi").drop("pair")
    more = asked.filter("size(parents) > 2")
    if more.isEmpty():
        return two
    found = _having_more(more, elements, ["node"], upto).select("node").distinct()
    return two.unionByName(more.join(found.hint("merge"), "node", "left_semi").drop("pair"))


# --- validation ---------------------------------------------------------------


def violations(mesh: Mesh) -> DataFrame:
    """``(violation, rows)`` for every broken rule of the mesh contract."""
    known = {s.code: str(s.vertices) for s in of_dim(mesh.dim)}
    n_nodes = F.broadcast(mesh.nodes.agg(F.count(F.lit(1)).alias("n")))
    anywhere = {s.code: "true" for s in shapes().values()}

    def count(rows: DataFrame, name: str, condition: str) -> DataFrame:
        return rows.filter(condition).groupBy(F.lit(name).alias("violation")) \
            .agg(F.count(F.lit(1)).alias("rows"))

    els = mesh.elements.crossJoin(n_nodes)
    hang = mesh.constraints.crossJoin(n_nodes)
    outside = "node < 0 OR node >= n OR exists(parents, v -> v < 0 OR v >= n)"
    shaped = "size(parents) BETWEEN 2 AND 8 AND size(parents) = size(weights)"
    weight = "aggregate(weights, 0D, (a, w) -> a + w)"
    out = [
        count(els, "unknown shape", f"{case(anywhere, 'false')} = false"),
        count(els, "element of another dimension",
              f"{case(anywhere, 'false')} AND {case(known)} IS NULL"),
        count(els, "vertex count does not match the shape", f"size(con) <> {case(known)}"),
        count(els, "element vertex out of range", "exists(con, v -> v < 0 OR v >= n)"),
        count(hang, "constraint needs 2 to 8 parents with one weight each", f"NOT ({shaped})"),
        count(hang, "constraint node out of range", outside),
        count(hang, "constraint parents are not distinct nodes",
              "size(array_distinct(parents)) < size(parents) OR array_contains(parents, node)"),
        count(hang, "constraint weights do not sum to 1",
              f"isnan({weight}) OR abs({weight} - 1) > 1e-12"),
        count(hang.groupBy("node").count(), "node is constrained twice", "count > 1"),
    ]
    each = mesh.constraints.filter(shaped).select(
        "seq", "node", F.explode(F.arrays_zip("parents", "weights")).alias("t")) \
        .selectExpr("seq", "node", "t.parents AS node_id", "t.weights AS w").join(mesh.nodes.hint("merge"), "node_id")
    means = each.groupBy("seq", "node").agg(
        *[F.sum(F.expr(f"w * {c}")).alias(f"m{c}") for c in "xyz"],
        *[F.greatest(F.lit(1.0), F.max(F.abs(F.col(c)))).alias(f"s{c}") for c in "xyz"])
    placed = means.join(mesh.nodes.hint("merge"), means["node"] == mesh.nodes["node_id"])
    off = " OR ".join(f"NOT (abs({c} - m{c}) <= 1e-9 * s{c}) OR isnan({c} - m{c})" for c in "xyz")
    out.append(count(placed, "hanging node is not at its parents' mean", off))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def validate(mesh: Mesh) -> None:
    if mesh.dim not in (2, 3):
        raise InvalidMesh(f"dim must be 2 or 3, got {mesh.dim}")
    found = violations(mesh).collect()
    if found:
        raise InvalidMesh("; ".join(sorted(r["violation"] for r in found)))


def _selection(mesh: Mesh, selected: DataFrame) -> DataFrame:
    """Distinct listed elements; raises for numbers that are no element's."""
    listed = selected.select(F.col("elem_id").cast("int").alias("elem_id")).distinct()
    stray = listed.join(mesh.elements.select("elem_id").hint("merge"), "elem_id", "left_anti")
    if not stray.isEmpty():
        raise IndexError("element number out of range")
    return listed


# --- balance closure ----------------------------------------------------------


def _touched(mesh: Mesh) -> DataFrame:
    """``elem_id, seq``: the constraints whose hanging node is a vertex of the element; nodes before the first that hangs
    and after the last are passed over where the elements are read."""
    first, last = mesh.constraints.agg(F.min("node"), F.max("node")).first()
    able = incidence(mesh.elements).filter(F.col("node").between(F.lit(first), F.lit(last)))
    return able.join(mesh.constraints.select("node", "seq").hint("merge"), "node").select("elem_id", "seq")


def closure(mesh: Mesh, selected: DataFrame, check: bool = True) -> DataFrame:
    """Least superset of ``selected(elem_id)`` that keeps the mesh 1-irregular.

    Refining an element with a hanging vertex asks for every element that has
    all of that vertex' parents.  Which elements a constraint asks for is
    computed once, as is which constraints an element touches; each round moves
    only those of the newly reached elements, so no element pairs are formed.
    """
    closed = _selection(mesh, selected) if check else selected.select("elem_id").distinct()
    if mesh.constraints.isEmpty():
        return closed
    touched_by = stage(_touched(mesh), "touched")
    asks_for = stage(elements_having(mesh.constraints, mesh.elements, ["seq"]), "asked")
    closed = frontier = stage(closed, "closed")
    fired: DataFrame | None = None
    while True:
        reached = frontier.join(touched_by.hint("merge"), "elem_id").select("seq").distinct()
        if fired is not None:
            reached = reached.join(fired.hint("merge"), "seq", "left_anti")
        reached = stage(reached, "reached")
        frontier = stage(reached.join(asks_for.hint("merge"), "seq").select("elem_id").distinct()
                         .join(closed.hint("merge"), "elem_id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return closed
        fired = reached if fired is None else stage(fired.unionByName(reached), "fired")
        closed = stage(closed.unionByName(frontier), "closed")


def ranked_closure(mesh: Mesh, ranked: DataFrame) -> DataFrame:
    """Closure of ``ranked`` (elem_id, e2) in marking order: ``elem_id, e2, source``.

    ``source`` is the first listed element, by descending ``e2`` and ascending number, whose closure reaches the element,
    and ``e2`` is its value; so the closure of any prefix of the list is a filter.  Ranks travel along the two sides of the
    closure's relation and only improvements go on, until there are none.
    """
    rank = F.struct((-F.col("e2")).alias("less"), F.col("elem_id").alias("source"))
    best = ranked.select("elem_id", rank.alias("rank"))
    if not mesh.constraints.isEmpty():
        touched_by = stage(_touched(mesh), "touched")
        asks_for = stage(elements_having(mesh.constraints, mesh.elements, ["seq"]), "asked")
        best = frontier = stage(best, "ranks")
        fired: DataFrame | None = None
        while not frontier.isEmpty():
            reached = frontier.join(touched_by.hint("merge"), "elem_id").groupBy("seq").agg(F.min("rank").alias("rank"))
            if fired is not None:
                known = fired.groupBy("seq").agg(F.min("rank").alias("known"))
                reached = reached.join(known.hint("merge"), "seq", "left").filter("known IS NULL OR rank < known").drop("known")
            reached = stage(reached, "reached")
            fired = reached if fired is None else fired.unionByName(reached)
            offered = reached.join(asks_for.hint("merge"), "seq").groupBy("elem_id").agg(F.min("rank").alias("rank"))
            known = best.withColumnRenamed("rank", "known")
            frontier = stage(offered.join(known.hint("merge"), "elem_id", "left").filter("known IS NULL OR rank < known").drop("known"), "frontier")
            best = stage(best.unionByName(frontier).groupBy("elem_id").agg(F.min("rank").alias("rank")), "ranks")
    return best.select("elem_id", (-F.col("rank.less")).alias("e2"), F.col("rank.source").alias("source"))


# --- red refinement -----------------------------------------------------------


def _int_array(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def new_node_requests(elements: DataFrame, dim: int) -> DataFrame:
    """Every node the elements' templates ask for: ``elem_id, ord, parents`` (ascending)."""
    asked = case({s.code: "array(" + ", ".join(
        "array_sort(array(" + ", ".join(f"con[{v}]" for v in node) + "))"
        for node in s.new_nodes) + ")" for s in of_dim(dim)})
    return elements.selectExpr("elem_id", f"posexplode({asked}) AS (ord, parents)")


def _children(dim: int) -> str:
    """Children of an element with ``local`` node numbers, as an array of structs."""
    def rows(children) -> str:
        return "array(" + ", ".join(
            f"named_struct('shape', {code}, 'con', array("
            + ", ".join(f"local[{i}]" for i in nodes) + "))" for code, nodes in children) + ")"

    values = {}
    for s in of_dim(dim):
        if len(s.choices) > 1:
            values[s.code] = case({k: rows(s.child_list(k)) for k in range(len(s.choices))},
                                  column="choice")
        else:
            values[s.code] = rows(s.child_list())
    return case(values)


def with_split_choice(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``choice``: how each tetrahedron is split (0 for other shapes)."""
    tets = with_positions(elements.filter(F.col("shape") == T4).select("elem_id", "con"), nodes, 3, 4)
    qualities = tets.selectExpr("*", *midpoints()) \
        .selectExpr("elem_id", *[f"{q} AS q{i}" for i, q in enumerate(split_qualities())])
    chosen = qualities.selectExpr("elem_id", f"{split_choice(['q0', 'q1', 'q2'])} AS choice")
    return elements.join(chosen.hint("merge"), "elem_id", "left").withColumn(
        "choice", F.coalesce("choice", F.lit(0)))


def _node_positions(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Position of each new node: the weighted sum of its parents in ascending order."""
    parents = rows.selectExpr("node", "posexplode(arrays_zip(parents, weights)) AS (k, t)") \
        .selectExpr("node", "k", "t.parents AS node_id", "t.weights AS w").join(nodes.hint("merge"), "node_id") \
        .selectExpr("node", "k", *[f"w * {c} AS {c}" for c in "xyz"]).repartition("node")
    gathered = parents.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))).alias("t"))
    sums = [f"aggregate(slice(t, 2, size(t)), t[0].{c}, (a, e) -> a + e.{c}) AS {c}" for c in "xyz"]
    return gathered.selectExpr("node AS node_id", *sums)


def _offsets(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each ``_bucket`` of ``rows``, the sums ``_o_*`` of the amounts ``_*`` in the buckets before it, and the totals."""
    totals = rows.groupBy("_bucket").agg(*[F.sum(f"_{n}").alias(f"_t_{n}") for n in names])
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(every), F.lit(0)).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"total_{n}") for n in names])


def _within_bucket(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add the exclusive running sums ``_l_*`` of the amounts ``_*`` inside each ``_bucket``."""
    local = Window.partitionBy("_bucket").orderBy("elem_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *[F.coalesce(F.sum(f"_{n}").over(local), F.lit(0)).alias(f"_l_{n}") for n in names])


def _before(elements: DataFrame, amounts: dict[str, str], bucket_rows: int = BUCKET) -> DataFrame:
    """Exclusive running sums over the dense ``elem_id``, and the totals.

    Same bucketed prefix as :func:`quadrille.plans.prefix.dense_ids`, for sums.
    """
    names = list(amounts)
    rows = elements.selectExpr("*", f"CAST(elem_id DIV {bucket_rows} AS BIGINT) AS _bucket",
                               *[f"{e} AS _{n}" for n, e in amounts.items()])
    return _within_bucket(rows, names).join(F.broadcast(_offsets(rows, names)), "_bucket").selectExpr(
        *elements.columns, *[f"_o_{n} + _l_{n} AS before_{n}" for n in names],
        *[f"total_{n}" for n in names])


def _flagged(elements: DataFrame, listed: DataFrame, amounts: dict[str, str], bucket_rows: int = BUCKET) -> DataFrame:
    """Elements with ``refined``, whether ``listed`` names them, and the amounts and their running sums by bucket.

    The list joins the elements in the windows' own shuffle, so an element moves once.
    """
    here = elements.selectExpr("elem_id", "shape", "con", "false AS refined", "true AS here")
    named = listed.selectExpr("elem_id", "CAST(NULL AS INT) AS shape", "CAST(NULL AS ARRAY<INT>) AS con", "true AS refined", "false AS here")
    same = Window.partitionBy("_bucket", "elem_id")
    rows = here.unionByName(named).withColumn("_bucket", F.expr(f"CAST(elem_id DIV {bucket_rows} AS BIGINT)")).repartition("_bucket") \
        .withColumn("refined", F.max("refined").over(same)).filter("here").drop("here")
    return _within_bucket(rows.selectExpr("*", *[f"{e} AS _{n}" for n, e in amounts.items()]), list(amounts))


def refine(mesh: Mesh, selected: DataFrame, check: bool = True) -> Refinement:
    """Red-refine the listed elements (a list closed under :func:`closure`).

    Old nodes keep their numbers, new ones follow in order of creation.  The
    children of the refined elements come first, parent by parent, then the
    other elements in their order.
    """
    if check:
        validate(mesh)
    listed = _selection(mesh, selected) if check else selected.select("elem_id").distinct()
    dim = mesh.dim
    n_children = case({s.code: str(s.children) for s in of_dim(dim)})
    flagged = stage(_flagged(mesh.elements, listed, {"kids": f"IF(refined, {n_children}, 0)", "kept": "IF(refined, 0, 1)"}), "flagged")
    refined = flagged.filter("refined").select("elem_id", "shape", "con")
    requests = stage(new_node_requests(refined, dim), "requests")
    n_old = mesh.nodes.count()

    # A requested node either hangs already or is created by its first request.
    old = mesh.constraints.selectExpr(
        "seq", "node", "array_sort(arrays_zip(parents, weights)) AS t").selectExpr(
        "seq", "node", "t.parents AS parents", "t.weights AS weights")
    listed_nodes = old.groupBy("parents").agg(
        F.min(F.struct("seq", "node", "weights")).alias("o")).selectExpr(
        "parents", "o.node AS node", "o.weights AS weights")
    wanted = requests.groupBy("parents").agg(F.min(F.struct("elem_id", "ord")).alias("first"))
    matched = stage(wanted.join(listed_nodes.hint("merge"), "parents", "left").selectExpr(
        "parents", "first.elem_id AS elem_id", "first.ord AS ord", "node", "weights"), "wanted")
    if not matched.filter("exists(weights, w -> w <> 1D / size(parents))").isEmpty():
        raise InvalidMesh("a hanging node is not where its parents' refinement puts it")
    created = stage(dense_ids(
        matched.filter("node IS NULL").select("parents", "elem_id", "ord"),
        "elem_id", ["elem_id", "ord"], "node", start=n_old), "created")
    prolongation = created.selectExpr(
        "node", "parents", "transform(parents, v -> 1D / size(parents)) AS weights")
    node_of = created.select("parents", "node").unionByName(
        matched.filter("node IS NOT NULL").select("parents", "node"))
    nodes = mesh.nodes.unionByName(_node_positions(prolongation, mesh.nodes))

    # Children in local numbering: vertices, then new nodes in template order.
    added = requests.join(node_of.hint("merge"), "parents").select("elem_id", "ord", "node").repartition("elem_id").groupBy("elem_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "node"))).alias("added"))
    local = refined.join(added.hint("merge"), "elem_id").selectExpr(
        "elem_id", "shape", "con", "concat(con, transform(added, a -> a.node)) AS local")
    local = with_split_choice(local, mesh.nodes) if dim == 3 else local.withColumn("choice", F.lit(0))
    places = flagged.join(F.broadcast(stage(_offsets(flagged, ["kids", "kept"]), "offsets")), "_bucket")
    starts = places.filter("refined").selectExpr("elem_id", "_o_kids + _l_kids AS before_kids")
    children = local.join(starts.hint("merge"), "elem_id") \
        .selectExpr("before_kids", f"posexplode({_children(dim)}) AS (k, c)") \
        .selectExpr("CAST(before_kids + k AS INT) AS elem_id", "c.shape AS shape", "c.con AS con")
    kept = places.filter("NOT refined").selectExpr(
        "CAST(total_kids + _o_kept + _l_kept AS INT) AS elem_id", "shape", "con")
    elements = stage(children, "children").unionByName(kept)  # the others stay where they are written

    # A node hangs while some element still has all of its parents.
    rows = prolongation.selectExpr("node", "parents", "weights", "-1 AS seq").unionByName(
        old.select("node", "parents", "weights", "seq"))
    hanging = stage(had_by_any(rows, elements), "hanging")
    new_hanging = dense_ids(hanging.filter("seq < 0").drop("seq"), "node", ["node"], "seq")
    still = hanging.filter("seq >= 0").withColumnRenamed("seq", "old_seq")
    first = F.broadcast(new_hanging.agg(F.count(F.lit(1)).alias("first")))
    still = dense_ids(still, "old_seq", ["old_seq"], "rank").crossJoin(first).selectExpr(
        "node", "parents", "weights", "CAST(first + rank AS INT) AS seq")
    columns = ["seq", "node", "parents", "weights"]
    constraints = new_hanging.select(*columns).unionByName(still.select(*columns))
    return Refinement(Mesh(dim, stage(nodes, "nodes"), elements, stage(constraints, "constraints")),
                      prolongation)


def prolong(values: DataFrame, prolongation: DataFrame) -> DataFrame:
    """Carry ``values(node_id, value)`` to a refined mesh: old nodes keep theirs."""
    parents = prolongation.select("node", F.explode(F.arrays_zip("parents", "weights")).alias("t")) \
        .selectExpr("node", "t.parents AS node_id", "t.weights AS w")
    new = parents.join(values.hint("merge"), "node_id").groupBy("node").agg(
        F.sum(F.col("w") * F.col("value")).alias("value"))
    return values.select("node_id", "value").unionByName(
        new.selectExpr("node AS node_id", "value"))


# --- checks -------------------------------------------------------------------


def irregular_constraints(mesh: Mesh) -> DataFrame:
    """Constraints with a hanging parent; a 1-irregular mesh has none."""
    each = mesh.constraints.select("seq", "node", F.explode("parents").alias("parent"))
    return each.join(mesh.constraints.selectExpr("node AS parent").hint("merge"), "parent", "left_semi") \
        .select("seq", "node").distinct()


def facet_counts(mesh: Mesh) -> DataFrame:
    """How many simplices share each facet: ``facet, elements``."""
    facet = "explode(transform(con, v -> array_sort(array_remove(con, v)))) AS facet"
    return mesh.elements.filter("shape IN (0, 4)").selectExpr(facet) \
        .groupBy("facet").agg(F.count(F.lit(1)).alias("elements"))


def coincident_nodes(mesh: Mesh) -> DataFrame:
    """Positions held by more than one node."""
    return mesh.nodes.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")


def unlisted_hanging(mesh: Mesh) -> DataFrame:
    """Edge midpoints that are nodes of an unrefined edge but carry no constraint.

    Together with distinct positions and full coverage this is the conformity
    of the mesh along edges; positions must be exactly representable.
    """
    edges = _pairs(mesh.elements.filter("shape IN (0, 4)")).distinct().selectExpr(
        "CAST(shiftright(pair, 32) AS INT) AS lo", "CAST(pair & 4294967295L AS INT) AS hi")
    a, b = mesh.nodes.alias("a").hint("merge"), mesh.nodes.alias("b").hint("merge")
    middles = edges.join(a, F.col("lo") == F.col("a.node_id")).join(b, F.col("hi") == F.col("b.node_id")) \
        .selectExpr("lo", "hi", *[f"0.5D * a.{c} + 0.5D * b.{c} AS {c}" for c in "xyz"])
    found = middles.join(mesh.nodes.hint("merge"), ["x", "y", "z"])
    listed = mesh.constraints.filter("size(parents) = 2").selectExpr(
        "node AS node_id", "array_min(parents) AS lo", "array_max(parents) AS hi")
    return found.join(listed.hint("merge"), ["node_id", "lo", "hi"], "left_anti").select("node_id", "lo", "hi")
