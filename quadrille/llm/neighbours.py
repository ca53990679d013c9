"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector of norm r is rotated by a fixed random rotation and kept as the signs of its coordinates: b, a unit vector with
coordinates of equal size.  With a the inner product of b and the rotated unit vector, the inner product of the vector
and a query q is estimated from the signs alone as r * <b, q> / a, with an error of at most
``EPS`` * r * |q| * sqrt((1 - a^2) / (a^2 (dim - 1))) except with a probability that falls as exp(-EPS^2 / 2) or
faster.  The index holds the packed signs and the scalars r and a of *every* row, beside the vector itself.

Search takes blocks of queries against blocks of rows, both dealt by a hash of their ids and of bounded size.  In a
block a query's best rows by estimate are ranked by their true products first; their k-th best product is a threshold,
and every row whose estimate plus error reaches it is ranked truly as well.  The k best of each block are merged.
The work is that of the stated queries against all rows, one bit a coordinate.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
shorter vectors count as padded with zeros.  A query is never its own candidate: rows that share its id are left out.
Ties go to the smaller id; equal vectors under different ids are candidates each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.llm.common import query, table

EPS, SEED = 3.3, 20240229
QUERY_BLOCK, ROW_BLOCK = 512, 16384
#: Rows ranked truly before the threshold is set.
PROBE = 3


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) &
                       F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def index(rows: DataFrame, dim: int) -> DataFrame:
    """vec_id, v (little-endian doubles), code (packed signs), r and a of every row."""
    def run(batches):
        turn = rotation(dim)
        for batch in batches:
            v = matrix(batch.column(1), dim)
            big = np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
            u = v / big
            short = np.sqrt((u * u).sum(axis=1))
            turned = (u / short[:, None]) @ turn
            a = np.abs(turned).sum(axis=1) / np.sqrt(dim)
            codes = np.packbits(turned >= 0, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(short * big[:, 0], pa.float64()), pa.array(np.minimum(a, 1.0), pa.float64())], names=["vec_id", "v", "code", "r", "a"])

    return rows.mapInArrow(run, "vec_id long, v binary, code binary, r double, a double")


def search_block(rows: pa.Table, queries: pa.Table, dim: int, k: int, eps: float):
    """(query_id, vec_id, score) arrays of each query's k best rows of a block, by estimates, bounds and true ranking."""
    ids = rows["vec_id"].to_numpy()
    v = np.frombuffer(b"".join(rows["v"].to_pylist()), "<f8").reshape(-1, dim)
    bits = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    r, a = rows["r"].to_numpy(), rows["a"].to_numpy()
    scale = (r / a / np.sqrt(dim)).astype(np.float64)
    slack = eps * r * np.sqrt((1 - a * a) / (a * a * max(dim - 1, 1))) + 1e-5 * r
    qid = queries["vec_id"].to_numpy()
    q = np.frombuffer(b"".join(queries["v"].to_pylist()), "<f8").reshape(-1, dim)
    length = queries["r"].to_numpy()
    unit = (q / length[:, None]) @ rotation(dim)
    out_q, out_v, out_s = [], [], []
    scale, slack = scale.astype(np.float32), slack.astype(np.float32)
    probe, longest = min(len(ids), PROBE * k), float(r.max())
    step = max(1, (1 << 22) // max(len(ids), 1))
    for first in range(0, len(qid), step):
        estimates = (unit[first:first + step].astype(np.float32) @ signs.T) * scale
        best = np.argpartition(estimates, len(ids) - probe, axis=1)[:, len(ids) - probe:]
        estimates += slack
        for row, reach in enumerate(estimates):
            me = first + row
            sure = best[row][ids[best[row]] != qid[me]]
            if len(sure) >= k:
                true = v[sure] @ q[me]
                floor = np.partition(true, len(true) - k)[len(true) - k]
                chosen = np.union1d(np.flatnonzero(reach >= np.float32(floor / length[me])), sure)
            else:
                chosen = np.arange(len(ids))
            chosen = chosen[ids[chosen] != qid[me]]
            near = v[chosen] @ q[me]
            if len(near) > k:  # a product differs from the exact sum by far less than this margin
                floor = np.partition(near, len(near) - k)[len(near) - k]
                chosen = chosen[near >= floor - 1e-12 * longest * length[me]]
            true = np.cumsum(v[chosen] * q[me], axis=1)[:, -1]  # added up in order of the components
            top = np.lexsort((ids[chosen], -true))[:k]
            out_q.append(np.full(len(top), qid[me]))
            out_v.append(ids[chosen][top])
            out_s.append(true[top])
    return [np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_v, out_s)]


def nearest(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", eps: float = EPS) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of each row for which ``is_query`` (over vec_id) holds."""
    rows = usable(df, vec_id, vector)
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count_if(is_query).alias("m")).first()
    dim, n = facts["dim"] or 1, facts["n"]
    q_blocks = -(-max(facts["m"], 1) // QUERY_BLOCK)
    r_blocks = -(-max(n, 1) // ROW_BLOCK)
    coded = index(rows, dim)
    block = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    right = (coded.withColumn("bb", block(r_blocks, 1))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    left = (coded.filter(is_query).select("vec_id", "v", "r").withColumn("qb", block(q_blocks, 2))
            .withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))))

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if len(queries) and len(rows):
            q, v, s = search_block(rows, queries, dim, k, eps)
        else:
            q = v = s = np.zeros(0)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(v.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    found = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query("op10_neighbours", SQL)
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
