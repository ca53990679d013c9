"""How the tables become points, errors and meshes.

All bindings are integer arithmetic, so both engines see the same values.  Each
is given once as Spark SQL and once as DuckDB SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.grid import Grid
from quadrille.operators.points import encode_points, tree_of_points


@dataclass(frozen=True)
class Points:
    """A point set with the capacity its tree is built for."""

    grid: Grid
    table: str
    spark: tuple[str, ...]
    duck: str
    capacity: int
    #: Expressions over the table whose maxima, plus one, stand for ``{top}`` and ``{last}`` in ``spark``.
    top: str | None = None
    last: str | None = None

    def rows(self, spark: SparkSession, sf: str) -> DataFrame:
        table = spark.read.parquet(f"{sf}/{self.table}.parquet")
        asked = {"{" + name + "}": e for name, e in (("top", self.top), ("last", self.last)) if e}
        most = table.agg(*[F.expr(f"max({e})") for e in asked.values()]).first() if asked else ()
        columns = list(self.spark)
        for name, value in zip(asked, most):
            columns = [e.replace(name, f"{(value or 0) + 1}L") for e in columns]
        return table.selectExpr(*columns)

    def load(self, spark: SparkSession, sf: str) -> DataFrame:
        return encode_points(self.rows(spark, sf), self.grid)

    def tree(self, spark: SparkSession, sf: str) -> DataFrame:
        return tree_of_points(self.load(spark, sf), self.grid, self.capacity)


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_TOP = f"(SELECT max({_CENTS} * {_CENTS}) + 1 FROM lineitem)"
# Without a time zone on either side, so that the session's does not matter.
_MINUTES = ("datediff(CAST(ts AS DATE), DATE'2024-01-01') * 1440L + hour(CAST(ts AS TIMESTAMP_NTZ)) * 60L "
            "+ minute(CAST(ts AS TIMESTAMP_NTZ))")
_LINE = "l_orderkey * 8 + l_linenumber AS pid"

_DUCK_MINUTES = "CAST(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT)"

# Users against time, each scaled down once it outgrows the domain: a thin, densely filled strip.
EVENTS = Points(
    Grid(2, 16), "events",
    ("event_id AS pid", "CAST(user_id AS BIGINT) DIV ({top} DIV 65536 + 1) AS x", f"CAST({_MINUTES} AS BIGINT) DIV ({{last}} DIV 65536 + 1) AS y",
     "CAST(round(value * 100) AS BIGINT) AS w"),
    "SELECT event_id AS pid, user_id // ((SELECT max(user_id) + 1 FROM events) // 65536 + 1) AS x, "
    f"{_DUCK_MINUTES} // ((SELECT max({_DUCK_MINUTES}) + 1 FROM events) // 65536 + 1) AS y, "
    "CAST(round(value * 100) AS BIGINT) AS w FROM events", 4, "user_id", _MINUTES)

# Squared prices, scaled by the largest, against order lines: density falls along x.
LINES = Points(
    Grid(2, 12), "lineitem",
    (_LINE, f"{_CENTS} * {_CENTS} DIV ({{top}} DIV 4096 + 1) AS x",
     "(l_orderkey * l_linenumber) % 4096 AS y", f"{_CENTS} AS w"),
    f"SELECT {_LINE}, {_CENTS} * {_CENTS} // ({_TOP} // 4096 + 1) AS x, "
    f"(l_orderkey * l_linenumber) % 4096 AS y, {_CENTS} AS w FROM lineitem", 16, f"{_CENTS} * {_CENTS}")

LINES_3D = Points(
    Grid(3, 8), "lineitem",
    (_LINE, f"{_CENTS} * {_CENTS} DIV ({{top}} DIV 256 + 1) AS x",
     "(l_orderkey * l_linenumber) % 256 AS y", "(l_partkey * l_partkey) % 65536 DIV 256 AS z",
     f"{_CENTS} AS w"),
    f"SELECT {_LINE}, {_CENTS} * {_CENTS} // ({_TOP} // 256 + 1) AS x, "
    "(l_orderkey * l_linenumber) % 256 AS y, (l_partkey * l_partkey) % 65536 // 256 AS z, "
    f"{_CENTS} AS w FROM lineitem", 16, f"{_CENTS} * {_CENTS}")

VECTORS = Points(
    Grid(3, 8), "embeddings",
    ("vec_id AS pid", *[f"CAST(floor((CAST(embedding[{i}] AS DOUBLE) + 1) * 128) AS BIGINT) AS {a}"
                        for i, a in enumerate("xyz")], "vec_id AS w"),
    "SELECT vec_id AS pid, " + ", ".join(
        f"CAST(floor((CAST(embedding[{i + 1}] AS DOUBLE) + 1) * 128) AS BIGINT) AS {a}"
        for i, a in enumerate("xyz")) + ", vec_id AS w FROM embeddings", 2)

# Columns of a structured mesh; the table's largest key sets the number of rows.
MESH_COLUMNS = 50


def mesh_nodes(spark: SparkSession, sf: str, table: str, key: str, dim: int) -> tuple[int, ...]:
    """Nodes per axis of a mesh with one cell per key."""
    cells = spark.read.parquet(f"{sf}/{table}.parquet").agg(F.max(key)).first()[0] + 1
    if dim == 2:
        return MESH_COLUMNS + 1, -(-cells // MESH_COLUMNS) + 1
    return 10 + 1, 10 + 1, -(-cells // 100) + 1
