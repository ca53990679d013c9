"""Unstructured meshes: templates, refinement, closure and adaptation."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry as geo
from quadrille.operators import mesh as U
from quadrille.operators import shapes as S
from quadrille.operators.adapt import AdaptParams, AdaptStatus, adapt
from quadrille.operators.marking import Params
from quadrille.operators.structured import structured

REFERENCE = {
    S.T3: [(0, 0), (1, 0), (0, 1)],
    S.Q4: [(0, 0), (1, 0), (1, 1), (0, 1)],
    S.T4: [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)],
    S.H8: [(x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))],
    S.W6: [(x, y, z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (0, 1))],
    S.P5: [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1)],
}
# Measure of the reference element, elements and nodes after one refinement of all.
REFINED = {S.T3: (0.5, 4, 6), S.Q4: (1, 4, 9), S.T4: (1 / 6, 8, 10), S.H8: (1, 8, 27), S.W6: (0.5, 8, 18),
           S.P5: (1 / 3, 10, 14)}


def listed(spark, *elements):
    return spark.createDataFrame([(e,) for e in elements], "elem_id int")


def counts(mesh):
    return mesh.elements.count(), mesh.nodes.count(), mesh.constraints.count()


def check_number(mesh):
    """A number that pins element order, vertex order and node numbers."""
    row = F.expr("(elem_id + 1L) * aggregate(transform(con, (v, j) -> (j + 1L) * v), 0L, (a, b) -> a + b)")
    return mesh.elements.agg(F.sum(row % 1_000_000_007)).first()[0] % 1_000_000_007


@pytest.mark.parametrize("code", REFERENCE, ids=lambda c: S.NAMES[c])
def test_refine_reference_element(spark, code):
    shape = S.shape(code)
    mesh = U.mesh_of(spark, shape.dim, REFERENCE[code], [(code, range(shape.vertices))])
    fine = U.refine(mesh, listed(spark, 0)).mesh
    measure, elements, nodes = REFINED[code]
    assert counts(fine) == (elements, nodes, 0)
    sizes = geo.with_measures(U.with_positions(fine.elements, fine.nodes, shape.dim), shape.dim).collect()
    assert all(r["signed_measure"] > 0 for r in sizes)
    assert sum(r["measure"] for r in sizes) == pytest.approx(measure, rel=1e-12)


def test_tetrahedron_choices_agree_with_permuted_splits():
    t = S.shape(S.T4)
    local = [(i, i) for i in range(4)] + list(t.new_nodes)
    ours = {frozenset(frozenset(local[n] for n in nodes) for _, nodes in t.child_list(k)) for k in range(3)}
    assert ours == set(S.kuhn_candidates(3)) and len(S.kuhn_candidates(2)) == 1
    assert len(S.lattice_points(3)) == 10
    with pytest.raises(ValueError):
        S.kuhn_split(3, (0, 1, 1, 2))


def test_two_triangles(spark):
    mesh = U.mesh_of(spark, 2, [(0, 0), (1, 0), (0, 1), (1, 1)], [(S.T3, [0, 1, 2]), (S.T3, [1, 3, 2])])
    one = U.refine(mesh, listed(spark, 0, 0)).mesh
    assert counts(one) == (5, 7, 1)
    assert [tuple(r) for r in one.constraints.select("parents", "weights").collect()] == [([1, 2], [0.5, 0.5])]
    # refining a child at the hanging node asks for the unrefined triangle
    child = one.elements.filter(F.array_contains("con", 4)).first()["elem_id"]
    assert {r[0] for r in U.closure(one, listed(spark, child)).collect()} == {child, 4}
    two = U.refine(one, listed(spark, 4))
    assert counts(two.mesh) == (8, 9, 0) and two.prolongation.count() == 2
    linear = one.nodes.selectExpr("node_id", "3 * x - 2 * y + 1 AS value")
    moved = U.prolong(linear, two.prolongation).join(two.mesh.nodes, "node_id")
    assert moved.filter("value <> 3 * x - 2 * y + 1").isEmpty() and moved.count() == 9


def test_listed_hanging_node_is_reused(spark):
    nodes = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)]
    elements = [(S.T3, [0, 1, 2]), (S.T3, [1, 3, 2])]
    mesh = U.mesh_of(spark, 2, nodes, elements, [(4, [2, 1], [0.5, 0.5])])
    assert U.refine(mesh, listed(spark, 0)).mesh.nodes.count() == 7
    off = U.mesh_of(spark, 2, [*nodes[:4], (0.75, 0.25)], elements, [(4, [1, 2], [0.75, 0.25])])
    with pytest.raises(U.InvalidMesh):
        U.refine(off, listed(spark, 0))
    with pytest.raises(IndexError):
        U.refine(mesh, listed(spark, 2))


def test_hexahedron_on_pyramid(spark):
    nodes = [*REFERENCE[S.H8], (0.5, 0.5, 2)]
    mesh = U.mesh_of(spark, 3, nodes, [(S.H8, range(8)), (S.P5, [4, 5, 6, 7, 8])])
    fine = U.refine(mesh, listed(spark, 0)).mesh
    rows = fine.constraints.collect()
    assert len(rows) == 5
    assert sorted(r["weights"] for r in rows)[0] == [0.25] * 4
    last = fine.elements.agg(F.max("elem_id")).first()[0]
    assert counts(U.refine(fine, listed(spark, last)).mesh)[2] == 0


INVALID = {
    "vertex out of range": dict(elements=[(S.T3, [0, 1, 9])]),
    "vertex count": dict(elements=[(S.T3, [0, 1])]),
    "unknown shape": dict(elements=[(7, [0, 1, 2])]),
    "another dimension": dict(elements=[(S.T4, [0, 1, 2, 3])]),
    "2 to 8 parents": dict(constraints=[(4, [1], [1.0])]),
    "not distinct": dict(constraints=[(4, [1, 1], [0.5, 0.5])]),
    "sum to 1": dict(constraints=[(4, [1, 2], [0.5, 0.4])]),
    "constrained twice": dict(constraints=[(4, [1, 2], [0.5, 0.5])] * 2),
    "parents' mean": dict(constraints=[(4, [0, 1], [0.5, 0.5])]),
    "node out of range": dict(constraints=[(4, [1, 77], [0.5, 0.5])]),
}


def test_validate(spark):
    nodes = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5)]
    for message, change in INVALID.items():
        parts = dict(elements=[(S.T3, [0, 1, 2])], constraints=[]) | change
        with pytest.raises(U.InvalidMesh, match=message):
            U.validate(U.mesh_of(spark, 2, nodes, parts["elements"], parts["constraints"]))


@pytest.mark.parametrize("dim,dims,nodes", [(2, (4, 3), (5, 4)), (2, (1, 1), (6, 6)), (3, (1, 2, 3), (3, 4, 3))])
def test_structured(spark, dim, dims, nodes):
    mesh = structured(spark, dims, nodes, [0.25] * dim)
    cells, points, box = 1, 1, 1.0
    for d, n in zip(dims, nodes):
        cells, points, box = cells * (n - 1), points * n, box * d
    assert counts(mesh) == (cells * (2 if dim == 2 else 6), points, 0)
    sizes = geo.with_measures(U.with_positions(mesh.elements, mesh.nodes, dim), dim)
    low, total = sizes.agg(F.min("signed_measure"), F.sum("measure")).first()
    assert low > 0 and total == pytest.approx(box)
    assert {r[0] for r in U.facet_counts(mesh).select("elements").distinct().collect()} <= {1, 2}


def test_split_ties(spark):
    mesh = structured(spark, (512,) * 3, (4,) * 3, (0,) * 3)
    p = U.with_positions(mesh.elements, mesh.nodes, 3, 4).selectExpr("*", *geo.midpoints())
    q = p.selectExpr(*[f"{e} AS q{i}" for i, e in enumerate(geo.split_qualities())])
    best = q.selectExpr("array_sort(array(q0, q1, q2)) AS s")
    assert q.count() == 162 and best.filter("s[2] <= s[1] * (1 + 1e-9D)").count() == 54


GOLDEN = {
    2: ((8, 8), (9, 9), [(155, 104, 19, 3572890), (185, 130, 37, 5364651), (242, 173, 63, 11083811)]),
    3: ((4, 4, 4), (5, 5, 5), [(559, 251, 124, 137702076), (1308, 537, 338, 753449987)]),
}


@pytest.mark.parametrize("dim", GOLDEN)
def test_cycles(spark, dim):
    dims, nodes, want = GOLDEN[dim]
    mesh = structured(spark, dims, nodes, (0,) * dim).staged()
    for row in want:
        marks = mesh.elements.selectExpr("elem_id", "CAST((elem_id * 7919L) % 1000 AS DOUBLE) AS error",
                                         "IF((elem_id * 104729L) % 10 < 3, 1.5D, 0.5D) AS ratio")
        a = adapt(mesh, marks, AdaptParams(Params(0.15, 0.30)))
        assert a.status is AdaptStatus.REFINED
        mesh = a.refinement.mesh
        assert (*counts(mesh), check_number(mesh)) == row
    assert U.irregular_constraints(mesh).isEmpty()
    assert U.coincident_nodes(mesh).isEmpty()
    assert U.unlisted_hanging(mesh).isEmpty()


def test_closure_against_naive_fixpoint(spark):
    mesh = structured(spark, (4, 4), (5, 5), (0, 0))
    mesh = U.refine(mesh, listed(spark, 0, 3, 9, 14, 20)).mesh
    con = {r["elem_id"]: set(r["con"]) for r in mesh.elements.collect()}
    hang = [(r["node"], set(r["parents"])) for r in mesh.constraints.collect()]
    start = {1, 5, 17}
    want = set(start)
    while True:
        more = {f for e in want for h, p in hang if h in con[e] for f in con if p <= con[f]} - want
        if not more:
            break
        want |= more
    assert {r[0] for r in U.closure(mesh, listed(spark, *start)).collect()} == want and want > start


def test_adapt_ceiling_is_the_longest_fitting_prefix(spark):
    mesh = structured(spark, (4, 4), (5, 5), (0, 0))
    mesh = U.refine(mesh, listed(spark, 0, 7, 12, 20)).mesh.staged()
    n = mesh.elements.count()
    marks = mesh.elements.selectExpr("elem_id", "CAST((elem_id * 13) % 17 + 1 AS DOUBLE) AS error", "2D AS ratio")
    budget = 24
    a = adapt(mesh, marks, AdaptParams(Params(1.0, 1.0, max_elements=n + budget)))
    assert a.status is AdaptStatus.REFINED
    order = [r["elem_id"] for r in a.marking.marked.orderBy(F.desc("e2"), "elem_id").collect()]
    picked = [r["elem_id"] for r in a.selected.orderBy(F.desc("e2"), "elem_id").collect()]
    assert picked == order[: len(picked)] and a.refinement.mesh.elements.count() <= n + budget
    longer = U.closure(mesh, listed(spark, *order[: len(picked) + 1])).count()
    assert 3 * longer > budget
    tiny = adapt(mesh, marks, AdaptParams(Params(1.0, 1.0, max_elements=n + 1)))
    assert tiny.status is AdaptStatus.ELEMENT_CEILING and tiny.refinement is None


def test_elements_share_parents_in_pairs():
    """Every new node of a template has parents that form an edge or a face."""
    for s in S.shapes().values():
        assert all(len(p) in (2, 4, 8) and len(set(p)) == len(p) for p in s.new_nodes)
        assert len({frozenset(p) for p in s.new_nodes}) == len(s.new_nodes)
        assert all(max(nodes) < s.vertices + len(s.new_nodes) for _, nodes in s.child_list())
        assert not any(a == b for a, b in combinations([n for _, n in s.child_list()], 2))


def test_rows_had_by_any_element(spark):
    solid = U.mesh_of(spark, 3, REFERENCE[S.H8] + [(2, 0, 0), (2, 2, 2)], [(S.H8, range(8)), (S.T4, (8, 1, 9, 5)), (S.T4, (8, 1, 2, 9))])
    asked = [(20, [1, 8]), (21, [0, 8]), (22, [0, 1, 2, 3]), (23, [0, 1, 2, 8]), (24, [3, 4]), (25, [2, 1]), (26, [1, 2, 8, 9])]
    rows = spark.createDataFrame(asked, "node int, parents array<int>")
    expected = {(20, 1), (20, 2), (22, 0), (24, 0), (25, 0), (25, 2), (26, 2)}
    assert set(map(tuple, U.elements_having(rows, solid.elements, ["node"]).collect())) == expected
    assert sorted((r["node"], r["parents"]) for r in U.had_by_any(rows, solid.elements).collect()) == [a for a in asked if a[0] in {n for n, _ in expected}]


def test_adapt_computes_indicators_once(spark):
    mesh = structured(spark, [6, 6], [7, 7], [0, 0]).staged()
    read = spark.sparkContext.accumulator(0)

    def given(batches):
        for b in batches:
            read.add(len(b))
            yield b.assign(error=b["elem_id"] % 7 + 1.0, ratio=2.0)[["elem_id", "error", "ratio"]]

    result = adapt(mesh, mesh.elements.select("elem_id").mapInPandas(given, "elem_id int, error double, ratio double"))
    assert result.status is AdaptStatus.REFINED and read.value == mesh.elements.count()


def test_positions_are_dealt_before_they_are_aggregated(spark):
    mesh = structured(spark, [3, 3, 3], [4, 4, 4], [0, 0, 0]).staged()
    plan = U.with_positions(mesh.elements, mesh.nodes, 3)._jdf.queryExecution().sparkPlan().toString()
    top = [line for line in plan.splitlines() if "HashAggregate" in line or "RepartitionByExpression" in line or "Exchange" in line]
    assert any("REPARTITION_BY_COL" in line for line in top)
