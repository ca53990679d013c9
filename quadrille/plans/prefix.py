"""Order-dependent operators without a single-task sort.

Rows are range-partitioned on their order, sorted inside each partition and
numbered there; the few per-partition totals turn local numbers into global
ones.  No row passes through the driver and no window spans the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.plans.staging import stage, width

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _ranged(df: DataFrame, keys: list) -> DataFrame:
    return df.repartitionByRange(width(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _offsets(totals: DataFrame) -> DataFrame:
    """Exclusive running total over partitions; one row per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))


def row_index(df: DataFrame, keys: list, name: str = "row_index") -> DataFrame:
    """Add each row's 0-based position in the order of ``keys``."""
    row = F.monotonically_increasing_id()
    local = stage(_ranged(df, keys).select(
        "*", F.shiftright(row, _LOCAL_BITS).alias("_part"),
        row.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local")), "indexed")
    totals = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_total"))
    return local.join(F.broadcast(_offsets(totals)), "_part").select(
        *df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def running_sum(df: DataFrame, keys: list, value: str, name: str = "running_sum",
                exclusive: bool = False) -> DataFrame:
    """Add the running total of ``value`` in the order of ``keys``."""
    kind = "double" if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)) else "bigint"
    rows = _ranged(df.withColumn("_value", F.col(value).cast(kind)), keys) \
        .withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("_local", T._parse_datatype_string(kind))])

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = 0
        for batch in batches:
            sums = batch["_value"].to_numpy().cumsum() + carry
            if len(sums):
                carry = sums[-1]
            yield batch.assign(_local=sums)

    local = stage(rows.mapInPandas(accumulate, schema), "running")
    totals = local.groupBy("_part").agg(F.sum("_value").alias("_total"))
    out = F.col("_local") + F.col("_before")
    if exclusive:
        out = out - F.col("_value")
    return local.join(F.broadcast(_offsets(totals)), "_part").select(
        *df.columns, out.cast(kind).alias(name))


def dense_ids(df: DataFrame, bucket_of: str, keys: list, name: str, start: int = 0,
              bucket_rows: int = 1 << 16) -> DataFrame:
    """Number rows from ``start`` in the order of ``keys``, led by a dense integer.

    ``bucket_of`` is a non-negative integer column whose order agrees with
    ``keys`` and of which no value repeats more than a few times (an element
    number, say), so runs of it are buckets of near-equal size: windows run per
    bucket and bucket offsets come from a count per bucket.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(bucket_of) / F.lit(bucket_rows)).cast("bigint"))
    totals = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return bucketed.withColumn("_local", local).join(F.broadcast(offsets), "_bucket").select(
        *df.columns, (F.col("_local") + F.col("_before") + F.lit(start - 1)).cast("int").alias(name))


def scan_report(df: DataFrame, keys: list, summarise, schema: str) -> DataFrame:
    """One summary row per range partition of ``df``, in key order inside each.

    ``summarise`` folds an iterator of sorted pandas batches into one dict.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = summarise(b for b in batches if len(b))
        if out is not None:
            yield pd.DataFrame([out])

    return _ranged(df, keys).mapInPandas(run, schema)


def previous_end(ends: np.ndarray, carry: int) -> np.ndarray:
    """Running maximum of the ends before each row."""
    shifted = np.concatenate(([carry], ends[:-1]))
    return np.maximum.accumulate(shifted)
