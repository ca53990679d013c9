"""Command line over SMX2 files: ``python -m quadrille.cli COMMAND IN OUT``.

    refine      mesh + int "elements"  ->  refined mesh + prolongation
    balance     mesh + int "elements"  ->  the mesh + int "balanced"
    adapt       mesh + double "error", "ratio", "params" (theta, cap, floor,
                ceiling, least growth)  ->  refined mesh, status and element sets
    structured  empty mesh + double "dims", "origin", int "nodes"  ->  seed mesh
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.adapt import AdaptParams, AdaptStatus, adapt
from quadrille.operators.marking import Params
from quadrille.operators.mesh import (
    CONSTRAINTS, ELEMENTS, NODES, Mesh, Refinement, closure, refine, validate,
)
from quadrille.operators.structured import structured
from quadrille.plans.prefix import row_index
from quadrille.session import get_session
from quadrille.sources.smx2 import Payload, read_smx2, write_smx2

COMMANDS = ("refine", "balance", "adapt", "structured")


def _positions(df: DataFrame, keys: list, value: str) -> DataFrame:
    return row_index(df, keys, "pos").selectExpr("pos", f"{value} AS value")


def _small(spark: SparkSession, values: list, kind: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"pos bigint, value {kind}")


def _short(payload: Payload, name: str, kind: str, limit: int) -> list:
    """A parameter array: at most ``limit`` values, checked on the stored count."""
    rows = payload.array(name, kind)
    if payload.counts[name] > limit:
        raise RuntimeError(f'"{name}" has {payload.counts[name]} values, at most {limit} are allowed')
    return [r["value"] for r in rows.orderBy("pos").collect()]


def _prolongation(r: Refinement) -> tuple[dict, dict]:
    rows = r.prolongation
    each = rows.selectExpr("node", "posexplode(arrays_zip(parents, weights)) AS (k, t)") \
        .selectExpr("node", "k", "t.parents AS parent", "t.weights AS weight")
    ints = {"prolongation_count": _positions(rows.selectExpr("node", "size(parents) AS n"), ["node"], "n"),
            "prolongation_parents": _positions(each, ["node", "k"], "parent")}
    return ints, {"prolongation_weights": _positions(each, ["node", "k"], "weight")}


def run(spark: SparkSession, command: str, source: str, target: str) -> None:
    payload = read_smx2(spark, source)
    mesh = payload.mesh

    def listed() -> DataFrame:
        return payload.array("elements").selectExpr("value AS elem_id")

    if command == "refine":
        r = refine(mesh, listed())
        ints, doubles = _prolongation(r)
        write_smx2(target, r.mesh, ints, doubles)
    elif command == "balance":
        validate(mesh)
        closed = closure(mesh, listed())
        write_smx2(target, mesh, {"balanced": _positions(closed, ["elem_id"], "elem_id")})
    elif command == "adapt":
        params = _short(payload, "params", "doubles", 5)
        if len(params) != 5:
            raise RuntimeError('"params" needs 5 values')
        error = payload.array("error", "doubles").selectExpr("pos AS elem_id", "value AS error")
        ratio = payload.array("ratio", "doubles").selectExpr("pos AS elem_id", "value AS ratio")
        a = adapt(mesh, error.join(ratio, "elem_id", "full"), AdaptParams(Params(*params[:4]), params[4]))
        by_error = [F.desc("e2"), "elem_id"]
        none = spark.createDataFrame([], "elem_id int")
        ints = {
            "status": _small(spark, [int(a.status)], "int"),
            "flagged": _positions(a.marking.flagged, ["elem_id"], "elem_id"),
            "candidates": _positions(a.marking.candidates, ["elem_id"], "elem_id"),
            "marked": _positions(a.marking.marked, by_error, "elem_id"),
            "selected": _positions(a.selected, by_error, "elem_id"),
            "balanced": _positions(none if a.balanced is None else a.balanced, ["elem_id"], "elem_id"),
        }
        doubles = {"seconds": _small(spark, list(a.seconds), "double")}
        if a.status in (AdaptStatus.REFINED, AdaptStatus.STAGNATED):
            more, weights = _prolongation(a.refinement)
            write_smx2(target, a.refinement.mesh, ints | more, doubles | weights)
        else:  # the caller keeps its mesh
            empty = Mesh(mesh.dim, *(spark.createDataFrame([], s) for s in (NODES, ELEMENTS, CONSTRAINTS)))
            write_smx2(target, empty, ints, doubles)
    elif command == "structured":
        write_smx2(target, structured(spark, _short(payload, "dims", "doubles", 3),
                                      _short(payload, "nodes", "ints", 3),
                                      _short(payload, "origin", "doubles", 3)))
    else:
        raise RuntimeError(f'unknown command "{command}"')


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    if len(args) != 3 or args[0] not in COMMANDS:
        print("usage: python -m quadrille.cli {refine|balance|adapt|structured} IN.smx OUT.smx",
              file=sys.stderr)
        return 2
    try:
        run(spark or get_session("quadrille-cli"), *args)
    except Exception as e:
        print(f"quadrille: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
