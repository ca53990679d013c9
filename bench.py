"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads.  Every
query runs to the end (all rows and columns are produced, none are collected).
The two ``circle`` entries repeat the published two-dimensional fixture of
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from quadrille import Grid, get_session  # noqa: E402
from quadrille.operators import oracles as O  # noqa: E402
from quadrille.operators import tree as T  # noqa: E402
from quadrille.operators.adapt import adapt  # noqa: E402
from quadrille.operators.balance import balance  # noqa: E402
from quadrille.plans.staging import stage  # noqa: E402
from quadrille.workload import meshes as W  # noqa: E402
from quadrille.workload import trees  # noqa: E402,F401
from quadrille.workload.registry import QUERIES  # noqa: E402

HEADLINES = [
    "morton_encode_2d", "neighbour_codes_2d", "points_tree_lines", "refine_converge_2d", "coarsen_once_2d",
    "balance_2d", "balance_histogram_lines", "violations_before_2d", "point_location_2d",
    "leaf_aggregate_2d", "verify_lines", "repartition_counts", "scalar_field_coarsen", "mark_selected",
    "element_measure_3d",
]


def force(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def circle(spark: SparkSession) -> tuple[Grid, DataFrame]:
    grid = Grid(2, 20)
    oracle = O.band(O.Config(max_level=20, coarse_level=3, fine_level=10))
    return grid, T.refine_converge(T.root(spark), grid, oracle)


def adapt_cycle(spark: SparkSession, sf: str, dim: int) -> None:
    mesh = W.seed_mesh(spark, sf, dim).staged()
    result = adapt(mesh, W.first_indicators(spark, sf, mesh), W.PARAMS)
    force(result.refinement.mesh.elements)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("quadrille-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                        spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    force(QUERIES["points_tree_2d"](spark, sf))  # start the JVM's workers outside the clock
    times: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINES:
        timed(name, lambda name=name: force(QUERIES[name](spark, sf)))
    for dim in (2, 3):
        timed(f"adapt_cycle_{dim}d", lambda dim=dim: adapt_cycle(spark, sf, dim))
    grid, leaves = circle(spark)
    staged = []
    timed("circle_refine", lambda: staged.append(stage(leaves, "circle")))
    timed("circle_balance", lambda: force(balance(staged[0], grid)))
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
