"""What the operators of this package share: tables, registration, Arrow plumbing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where SQL can express it."""
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of an id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def extend(df: DataFrame, source: str, fields: list[T.StructField],
           compute: Callable[[list], list[list]], binary: bool = False, keep: bool = False) -> DataFrame:
    """``df`` with ``source`` exchanged for columns computed from it (or kept beside them), one Arrow batch at a time.

    ``compute`` gets the values of ``source`` (text, or its UTF-8 bytes if ``binary``) and returns one list per new
    column.  A column of ``df`` with the name of a new one is replaced.  Rows are never moved, so no shuffle is needed.
    """
    new = {f.name.lower() for f in fields}
    carried = [c for c in df.columns if c.lower() not in new and c != source]
    inside = free_name(df, "source_text")
    df = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{source}`").alias(inside))
    same = [T.StructField(source, df.schema[inside].dataType)] if keep and source.lower() not in new else []
    schema = T.StructType([df.schema[c] for c in carried] + same + fields)
    dtypes = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            values = (column.cast(pa.binary()) if binary else column).to_pylist()
            made = compute(values)
            arrays = [batch.column(i) for i in range(len(carried) + len(same))] + [pa.array(x, type=t) for x, t in zip(made, dtypes)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
