"""Nothing that grows with a mesh is broadcast: files of numbers near each other are small beside what they hold, so Spark
would take tables of millions of rows for small ones and build them on the driver."""

import re

import pytest

from quadrille.operators import adapt as A
from quadrille.operators import conformity as C
from quadrille.operators import hybrid as H
from quadrille.operators import marking as K
from quadrille.operators import mesh as U
from quadrille.operators.structured import structured
from quadrille.workload import hybrids, meshes

#: One row for each bucket or part of a table.
SMALL = {"_bucket", "_part"}


def _broadcast(df) -> set[str]:
    """First keys of the joins that broadcast a side."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def written(monkeypatch):
    """Keys of broadcasts by the label of what was staged."""
    found = {}
    for module in (A, C, H, K, U):
        def spy(df, label="stage", *args, given=module.stage, **named):
            found.setdefault(label, set()).update(_broadcast(df) - SMALL)
            return given(df, label, *args, **named)

        monkeypatch.setattr(module, "stage", spy)
    return found


def _indicators(mesh):
    return mesh.elements.selectExpr("elem_id", "CAST(elem_id % 7 AS DOUBLE) AS error", "IF(elem_id % 3 = 0, 1.5D, 0.5D) AS ratio")


def test_cycles_broadcast_nothing_that_grows(spark, written, dim=3):
    mesh = structured(spark, [3] * dim, [4] * dim, [0] * dim).staged()
    for ceiling in (0, 100_000):
        done = A.adapt(mesh, _indicators(mesh), A.AdaptParams(K.Params(0.6, 0.6, 0.01, ceiling)))
        last, mesh = mesh, done.refinement.mesh
    values = last.nodes.selectExpr("node_id", "x AS value")
    selected = mesh.elements.filter("elem_id % 5 = 0").select("elem_id")
    results = {"closure": U.closure(mesh, selected), "elements": mesh.elements, "nodes": mesh.nodes, "constraints": mesh.constraints,
               "prolonged": U.prolong(values, done.refinement.prolongation), "violations": U.violations(mesh),
               "irregular": U.irregular_constraints(mesh), "unlisted": U.unlisted_hanging(mesh),
               "positions": U.with_positions(mesh.elements, mesh.nodes, dim)}
    assert {"closed", "touched", "asked", "hanging", "children", "indicators", "ranks"} <= set(written)
    assert {k: v for k, v in written.items() if v} == {}
    assert {k: b for k, v in results.items() if (b := _broadcast(v) - SMALL)} == {}


def test_queries_broadcast_nothing_that_grows(spark, sf, written, dim=2):
    mesh = meshes.seed_mesh(spark, sf, dim)
    assert not _broadcast(meshes.first_indicators(spark, sf, mesh)) - SMALL
    broken = hybrids.broken(spark, sf, dim)
    assert not _broadcast(C.coverage(broken, broken.nodes.selectExpr("node_id AS pid", "x", "y", "z"))) - SMALL
    assert {k: v for k, v in written.items() if v} == {}


def test_an_element_touches_the_constraints_of_its_vertices(spark):
    seed = structured(spark, [4, 4], [5, 5], [0, 0]).staged()
    mesh = U.refine(seed, seed.elements.filter("elem_id IN (3, 17, 18)").select("elem_id")).mesh
    want = {(r["elem_id"], c["seq"]) for r in mesh.elements.collect() for c in mesh.constraints.collect() if c["node"] in r["con"]}
    assert want and {tuple(r) for r in U._touched(mesh).collect()} == want
