"""Some queries against their SQL twins in DuckDB; the rest run the same way by the driver."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("lineitem", "orders", "events", "part", "embeddings")
NAMES = ["morton_encode_3d", "neighbour_codes_2d", "balance_2d", "leaf_aggregate_2d", "coarsen_once_2d",
         "region_leaves_3d", "repartition_physical", "element_measure_3d", "structured_elements_3d", "mark_fractional", "exact_sums",
         "random_subset_0", "random_subset_7"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(v[i] for i in order) for v in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in want.description], want.fetchall())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["level", "leaves"]
