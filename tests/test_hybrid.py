import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.functions.geometry import with_measures
from quadrille.operators import conformity as C
from quadrille.operators import hybrid as H
from quadrille.operators import mesh as U
from quadrille.operators import shapes as S
from quadrille.workload.hybrid_sql import CODES, SOLIDS, _templates
from quadrille.workload.meshes import _faces


def boxes(spark, dim, n, seed):
    draw = random.Random(seed)
    if dim == 2:
        return spark.createDataFrame([(i, j, draw.randrange(3)) for i in range(n) for j in range(n)], "i long, j long, kind int")
    return H.layered(spark.createDataFrame([(i, j, (i + j) % 2) for i in range(n) for j in range(n)], "i long, j long, kind int"))


def measure(mesh):
    rows = with_measures(U.with_positions(mesh.elements, mesh.nodes, mesh.dim), mesh.dim)
    return rows.agg(F.sum("signed_measure"), F.min("signed_measure")).first()


def some(mesh, seed, share):
    n = mesh.elements.count()
    return mesh.elements.filter(F.pmod(F.xxhash64("elem_id", F.lit(seed)), F.lit(1000)) < 1000 * share).select("elem_id"), n


def points(spark, hi, n=400):
    draw = random.Random(n)
    return spark.createDataFrame([(k, *(draw.random() * h for h in hi)) for k in range(n)], "pid long, x double, y double, z double")


@pytest.mark.parametrize("dim", [2, 3])
def test_refined_meshes_of_every_shape_stay_conforming(spark, dim):
    n = 3 if dim == 2 else 2
    mesh = H.hybrid(boxes(spark, dim, n, 1), dim)
    hi = (2 * n, 2 * n, 0 if dim == 2 else 8)
    volume = math.prod(h for h in hi if h)
    assert {r[0] for r in mesh.elements.select("shape").distinct().collect()} == {s.code for s in S.of_dim(dim)}
    U.validate(mesh)
    done = set()
    for cycle in range(3 if dim == 2 else 2):
        assert C.faults(mesh).collect() == []
        assert {r[1] for r in C.coverage(mesh, points(spark, hi)).collect()} == {1}
        assert measure(mesh)[0] == pytest.approx(volume) and measure(mesh)[1] > 0
        closed = U.closure(mesh, some(mesh, cycle, 0.3)[0])
        done |= {r[0] for r in closed.join(mesh.elements, "elem_id").select("shape").distinct().collect()}
        mesh = U.refine(mesh, closed).mesh
    assert C.faults(mesh).collect() == []
    assert done == {s.code for s in S.of_dim(dim)}
    sizes = {r[0] for r in mesh.constraints.selectExpr("size(parents)").distinct().collect()}
    assert sizes == ({2} if dim == 2 else {2, 4})


def test_closure_is_the_naive_fixed_point(spark):
    mesh = H.hybrid(boxes(spark, 3, 2, 2), 3)
    mesh = U.refine(mesh, U.closure(mesh, some(mesh, 5, 0.2)[0])).mesh
    elements = {r["elem_id"]: set(r["con"]) for r in mesh.elements.collect()}
    hanging = [(r["node"], set(r["parents"])) for r in mesh.constraints.collect()]
    for seed, share in ((1, 0.03), (2, 0.2)):
        chosen = some(mesh, seed, share)[0]
        closed = {r[0] for r in chosen.collect()}
        changed = True
        while changed:
            changed = False
            for node, parents in hanging:
                if any(node in elements[e] for e in closed):
                    more = {e for e, v in elements.items() if parents <= v} - closed
                    closed |= more
                    changed |= bool(more)
        assert {r[0] for r in U.closure(mesh, chosen).collect()} == closed


def test_a_shared_square_has_the_same_nodes_whichever_side_refines_first(spark):
    stacked = spark.createDataFrame([(0, 0, 0, H.HEXAHEDRON), (0, 0, 1, H.PYRAMIDS)], "i long, j long, k long, kind int")
    mesh = H.hybrid(stacked, 3)
    base = mesh.elements.filter("shape = 14").collect()
    hexahedron = mesh.elements.filter("shape = 5").first()
    pyramid = next(r for r in base if len(set(r["con"]) & set(hexahedron["con"])) == 4)
    ends = []
    for first, other in ((hexahedron, pyramid), (pyramid, hexahedron)):
        once = U.refine(mesh, mesh.elements.filter(F.col("elem_id") == first["elem_id"]))
        shared = [r for r in once.mesh.constraints.collect() if set(r["parents"]) <= set(other["con"]) & set(first["con"])]
        assert Counter(len(r["parents"]) for r in shared) == {2: 4, 4: 1}
        then = once.mesh.elements.filter(F.col("con") == F.lit(list(other["con"])))
        twice = U.refine(once.mesh, U.closure(once.mesh, then)).mesh
        assert C.faults(twice).collect() == []
        ends.append(sorted(tuple(r) for r in twice.nodes.select("x", "y", "z").collect()))
    assert ends[0] == ends[1]


def test_boxes_that_cannot_be_meshed(spark):
    schema = "i long, j long, k long, kind int"
    wrong = [[(0, 0, 0, 9)], [(0, 0, 0, None)], [(0, None, 0, 1)], [(0, 0, 0, 1), (0, 0, 0, 0)],
             [(0, 0, 0, H.HEXAHEDRON), (0, 0, 1, H.PATHS)], [(0, 0, 0, H.PATHS), (1, 0, 0, H.PRISMS)]]
    for rows in wrong:
        with pytest.raises(U.InvalidMesh):
            H.hybrid(spark.createDataFrame(rows, schema), 3)
    assert H.hybrid(spark.createDataFrame([], schema), 3).elements.count() == 0
    assert H.hybrid(spark.createDataFrame([(5, 7, 3, H.PATHS), (9, 0, 0, H.PRISMS)], schema), 3).elements.count() == 8


def test_sides_turn_outwards():
    for name, code in CODES.items():
        if S.shape(code).dim == 3:
            found = {frozenset(f) for f in _faces(SOLIDS[name])}
            assert {frozenset(f) for f in S.FACES[code]} == found
            middle = [sum(p[a] for p in SOLIDS[name]) / len(SOLIDS[name]) for a in range(3)]
            for f in S.FACES[code]:
                a, b, c = (SOLIDS[name][v] for v in f[:3])
                u, w, t = ([q[k] - a[k] for k in range(3)] for q in (b, c, middle))
                assert u[0] * (w[1] * t[2] - w[2] * t[1]) - u[1] * (w[0] * t[2] - w[2] * t[0]) + u[2] * (w[0] * t[1] - w[1] * t[0]) < 0


def test_templates_of_the_twin_agree():
    new, kids = _templates()
    for name, code in CODES.items():
        shape = S.shape(code)
        assert [sorted(p) for p in new[name]] == [sorted(p) for p in shape.new_nodes]
        for choice in range(max(len(shape.choices), 1)):
            mine = [(CODES[m], tuple(v)) for n, c, _, m, v in sorted((k for k in kids if k[0] == name and k[1] in (None, choice)), key=lambda k: k[2])]
            assert mine == list(shape.child_list(choice))


def test_each_fault_is_found_alone(spark):
    mesh = H.hybrid(boxes(spark, 2, 2, 3), 2)
    mesh = U.refine(mesh, mesh.elements.filter("elem_id = 0")).mesh.staged()
    first = mesh.constraints.first()["node"]

    def kinds(**changed):
        return {r["fault"] for r in C.faults(U.Mesh(2, changed.get("nodes", mesh.nodes), changed.get("elements", mesh.elements),
                                                    changed.get("constraints", mesh.constraints))).collect()}

    assert kinds() == set()
    assert "node hangs unlisted" in kinds(constraints=mesh.constraints.filter(f"node <> {first}"))
    assert "field jumps" in kinds(constraints=mesh.constraints.filter(f"node <> {first}"))
    leaning = mesh.constraints.withColumn("weights", F.array(F.lit(0.25), F.lit(0.75)))
    assert "node off its parents' mean" in kinds(constraints=leaning)
    corner = mesh.constraints.first()["parents"][0]
    extra = spark.createDataFrame([(99, corner, [first, corner + 1], [0.5, 0.5])], mesh.constraints.schema)
    assert {"node listed without hanging", "node hangs on a hanging node"} <= kinds(constraints=mesh.constraints.unionByName(extra))
    twin = mesh.nodes.filter(f"node_id = {first}").withColumn("node_id", F.lit(9999))
    assert {"position held twice", "node hangs unlisted"} == kinds(nodes=mesh.nodes.unionByName(twin))
    assert "element turned" in kinds(elements=mesh.elements.withColumn("con", F.reverse("con")))
    gone = U.Mesh(2, mesh.nodes, mesh.elements.limit(0), mesh.constraints)
    assert {r[1] for r in C.coverage(gone, points(spark, (4, 4, 0), 5)).collect()} == {0}


def test_ranked_closure_holds_the_closure_of_every_prefix(spark):
    mesh = H.hybrid(boxes(spark, 3, 2, 4), 3)
    for seed in (3, 4):
        mesh = U.refine(mesh, U.closure(mesh, some(mesh, seed, 0.15)[0])).mesh
    ranked = some(mesh, 6, 0.05)[0].selectExpr("elem_id", "CAST((elem_id * 37) % 11 AS DOUBLE) AS e2").cache()
    order = sorted(map(tuple, ranked.collect()), key=lambda r: (-r[1], r[0]))
    rows = [tuple(r) for r in U.ranked_closure(mesh, ranked).collect()]
    place = {e: k for k, (e, _) in enumerate(order)}
    assert all(dict(order)[source] == e2 for _, e2, source in rows) and len(rows) > len(order)
    for k in (1, len(order) // 2, len(order)):
        part = spark.createDataFrame(order[:k], "elem_id int, e2 double")
        assert {r[0] for r in U.closure(mesh, part).collect()} == {e for e, _, source in rows if place[source] < k}


def test_coverage_files_an_element_under_the_cells_it_has_an_inside_in(spark, monkeypatch):
    mesh = H.hybrid(spark.createDataFrame([(i, j, 0) for i in range(4) for j in range(4)], "i long, j long, kind int"), 2).staged()
    seen = {}

    def staged(df, label="stage", **options):
        seen[label] = df.count()
        return df

    monkeypatch.setattr(C, "stage", staged)
    assert {r[1] for r in C.coverage(mesh, points(spark, (8, 8, 0), 50)).collect()} == {1}
    assert seen["cells"] == 16  # squares that fill their cells
