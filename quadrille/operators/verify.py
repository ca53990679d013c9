"""Tree invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.grid import Grid
from quadrille.plans.prefix import previous_end, scan_report


class InvalidTree(ValueError):
    pass


def verify_report(leaves: DataFrame, grid: Grid) -> DataFrame:
    """One row of counts: leaves, each kind of violation, and the covered volume.

    Overlaps need neighbours in code order.  Leaves are range-partitioned by
    code, each task reports on its own range, and the last end before each
    range settles what happens between ranges.
    """
    dim, top = grid.dim, grid.max_level

    def summarise(batches):
        out = None
        for b in batches:
            code, level = b["code"].to_numpy(np.int64), b["level"].to_numpy(np.int64)
            bad_level = (level < 0) | (level > top)
            span = np.clip(dim * (top - np.clip(level, 0, top)), 0, 63).astype(np.int64)
            low = ~np.left_shift(np.int64(-1), span)
            low[span == 63] = np.iinfo(np.int64).max
            end = code | low
            if out is None:
                out = dict(first=int(code[0]), last=-1, leaves=0, out_of_range=0, misaligned=0,
                           outside=0, overlaps=0, volume=0.0)
            before = previous_end(end, out["last"])
            out["leaves"] += len(code)
            out["out_of_range"] += int(bad_level.sum())
            out["misaligned"] += int(((code & low) != 0).sum())
            out["outside"] += int(((code < 0) | (code > grid.last_code)).sum())
            out["overlaps"] += int((code <= before).sum())
            out["volume"] += float(np.exp2(-dim * np.clip(level, 0, top).astype(float)).sum())
            out["last"] = max(out["last"], int(end.max()))
        return out

    parts = scan_report(
        leaves.select("code", "level"), ["code", "level"], summarise,
        "first bigint, last bigint, leaves bigint, out_of_range bigint, misaligned bigint, "
        "outside bigint, overlaps bigint, volume double")
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.withColumn("before", F.max("last").over(before))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("leaves", "out_of_range", "misaligned", "outside")]
    return joined.agg(
        *sums,
        F.coalesce(F.sum(F.col("overlaps") + F.when(F.col("first") <= F.col("before"), 1)
                         .otherwise(0)), F.lit(0)).alias("overlaps"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))


def verify(leaves: DataFrame, grid: Grid) -> None:
    """Raise :class:`InvalidTree` unless the leaves tile the domain."""
    r = verify_report(leaves, grid).first()
    checks = [
        (r["leaves"] == 0, "the tree is empty"),
        (r["out_of_range"] > 0, "a leaf level is out of range"),
        (r["misaligned"] > 0, "a leaf code is not aligned to its level"),
        (r["outside"] > 0, "a leaf code is outside the domain"),
        (r["overlaps"] > 0, "leaves overlap"),
        (not abs(r["volume"] - 1.0) <= 1e-9, "leaf volumes do not sum to 1"),
    ]
    for failed, message in checks:
        if failed:
            raise InvalidTree(message)


def verify_volume(leaves: DataFrame, grid: Grid) -> None:
    """The volume check alone."""
    volume = verify_report(leaves, grid).first()["volume"]
    if not abs(volume - 1.0) <= 1e-9:
        raise InvalidTree("leaf volumes do not sum to 1")
