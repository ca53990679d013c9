"""Merkle manifest of a dataset: every row's leaf, root and witness, built by aligned appends.

Rows of a source stand in the order of their ids.  Each task appends the leaves of aligned blocks of ``FAN ** HEIGHT`` rows
one after the other.  A node that is appended attaches a partial witness: the digests before it in its run; each sibling
that is completed later extends the witnesses of those before it.  Witnesses are kept once per node, so all leaves below an
open subtree are extended in one step.  A full run becomes its parent, which is appended one level up.  The roots of blocks
are then further appends, dealt into blocks again, until each source has one root; the roots of sources, in their order, are
appended in the same way.  A leaf's whole witness is its block's steps, then those of the block's root, and so on.

Positions come from a range partitioning of ids and sources, numbered inside partitions; only counts per partition and
source meet.  A source with a third of all rows is as many blocks as its rows need; no block is larger than the others.

A leaf is the digest of its fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself.  Null sources are
one source, the first; null ids come first in theirs.  Rows that share source and id stand in the order of their digests;
equal rows are leaves of their own.  A source of one row has its leaf as root; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import query, remainder, table
from quadrille.plans.staging import scratch, stage, width

FAN, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"
_LOCAL = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Appender:
    """A tree that grows by appends; ``steps(level)`` are the siblings before and after each node of a level."""

    def __init__(self, fan: int = FAN):
        self.fan, self.size = fan, 0
        self.open: list[list[str]] = []  # completed nodes whose run is not full yet
        self.before: list[list[str]] = []
        self.after: list[list[str]] = []

    def append(self, node: str, level: int = 0) -> None:
        self.size += level == 0
        while True:
            if level == len(self.open):
                self.open.append([])
                self.before.append([])
                self.after.append([])
            run, after = self.open[level], self.after[level]
            for earlier in range(1, len(run) + 1):
                after[-earlier] += node
            self.before[level].append("".join(run))
            after.append("")
            run.append(node)
            if len(run) < self.fan:
                return
            node = digest(run)
            run.clear()
            level += 1

    def close(self, height: int | None = None) -> tuple[str, int]:
        """Complete what is open up to ``height``, or until one node remains; its digest, and the levels below it."""
        level = 0
        while len(self.before[level]) > 1 if height is None else level < height:
            if self.open[level]:
                node = digest(self.open[level])
                self.open[level].clear()
                self.append(node, level + 1)
            level += 1
        return self.open[level][0], level

    def steps(self, levels: int) -> pa.ListArray:
        """The steps of every leaf, through ``levels`` levels."""
        sizes = np.array([len(self.before[k]) for k in range(levels)], np.int64)
        at = (np.arange(self.size)[:, None] // self.fan ** np.arange(levels) + (np.cumsum(sizes) - sizes)).ravel()
        pool = [pa.array([x for k in range(levels) for x in side[k]], pa.string()).take(pa.array(at, pa.int64())) for side in (self.before, self.after)]
        pairs = pa.StructArray.from_arrays(pool, names=["before", "after"])
        return pa.ListArray.from_arrays(pa.array(np.arange(self.size + 1) * levels, pa.int32()), pairs)


def leaf(df: DataFrame, text: Column | None = None) -> Column:
    """The digest of a row's fields; ``text`` stands in for the column of that name."""
    fields = [text if f == "text" and text is not None else F.col(f"`{f}`") for f in FIELDS]
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and its steps lead to."""
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof(steps: Column) -> Column:
    """The digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, a row's place in its ``owner`` in the order of ``order``, and ``total``, its owner's rows."""
    keys = ["owner", *order]
    row = F.monotonically_increasing_id()
    placed = stage(nodes.repartitionByRange(width(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
                   .select("*", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit(_LOCAL)).alias("row")), "placed")
    counts = placed.groupBy("part", "owner").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = Window.partitionBy("owner").orderBy("part")  # a row for each partition at most
    offsets = counts.select("part", F.col("owner").alias("whose"), "first", F.sum("n").over(Window.partitionBy("owner")).alias("total"),
                            (F.sum("n").over(parts) - F.col("n")).alias("ahead"))
    return placed.join(offsets, (placed["part"] == offsets["part"]) & F.col("owner").eqNullSafe(F.col("whose"))).select(
        *nodes.columns, (F.col("row") - F.col("first") + F.col("ahead")).alias("pos"), "total")


def append_blocks(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """``nodes`` (owner, node, pos, total, ...) with ``block``, ``steps`` inside it and, on a block's first row, its ``top``."""
    size = fan ** height
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", block long, steps {STEPS}, top string"

    def close(rows: pa.RecordBatch) -> pa.RecordBatch:
        tree = Appender(fan)
        for node in rows["node"].to_pylist():
            tree.append(node)
        top, levels = tree.close(height if rows["total"][0].as_py() > size else None)
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, tree.steps(levels), pa.array([top] + [None] * (n - 1), pa.string())],
                                          names=[*rows.schema.names, "steps", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch["pos"].to_numpy() % size == 0)  # positions are dense, so a block starts there
            edges = [0, *starts, batch.num_rows]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if k and waiting:
                    yield close(_joined(waiting))
                    waiting = []
                if b > a:
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield close(_joined(waiting))

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(size)).cast("bigint")).repartition("owner", "block")
    return dealt.sortWithinPartitions("owner", "block", "pos").mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def witnesses(nodes: DataFrame, order: list[str], fan: int = FAN, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """One tree per ``owner`` over ``nodes`` (owner, node, ...) in the order of ``order``.

    Returns the nodes with ``block`` and the ``steps`` inside it, and per block (owner, block) the further ``steps`` to the
    owner's ``root``.
    """
    base = stage(append_blocks(numbered(nodes, order), fan, height), "blocks")
    most = base.agg(F.max("total")).first()[0] or 0
    levels, n = [base], -(-most // fan ** height)
    while n > 1:
        tops = levels[-1].filter("top is not null").select("owner", F.col("top").alias("node"), F.col("block").alias("pos"),
                                                           F.ceil(F.col("total") / F.lit(fan ** height)).cast("bigint").alias("total"))
        levels.append(stage(append_blocks(tops, fan, height), "blocks"))
        n = -(-n // fan ** height)
    upper = levels[-1].filter("top is not null").select("owner", "block", F.col("top").alias("root"), F.array().cast(STEPS).alias("steps"))
    for level in reversed(levels[1:]):
        low = level.select("owner", "pos", "block", F.col("steps").alias("low"))
        high = upper.select(F.col("owner").alias("whose"), F.col("block").alias("above"), "root", "steps")
        upper = low.join(high, F.col("owner").eqNullSafe(F.col("whose")) & (F.col("block") == F.col("above"))).select(
            "owner", F.col("pos").alias("block"), "root", F.concat("low", "steps").alias("steps"))
    return base.drop("top", "pos", "total"), upper


def manifest(leaves: DataFrame, order: list[str], fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """``leaves`` (owner, node, ...) with ``steps`` to the dataset's ``root``, and ``subroot``, that of their owner.

    Call it inside ``scratch``: the result reads staged tables.
    """
    rows, upper = witnesses(leaves, order, fan, height)
    upper = stage(upper, "owners")
    subroots = upper.filter("block = 0").select(F.lit("all").alias("owner"), F.col("owner").alias("name"), F.col("root").alias("node"))
    tops, over = witnesses(subroots, ["name"], fan, height)
    tops = tops.join(over.select(F.col("block").alias("above"), "root", F.col("steps").alias("rest")), F.col("block") == F.col("above"))
    tops = stage(tops.select("name", "root", F.concat("steps", "rest").alias("rest")), "tops")
    blocks = upper.select(F.col("owner").alias("whose"), F.col("block").alias("above"), F.col("root").alias("subroot"), F.col("steps").alias("high"))
    blocks = blocks.join(tops, F.col("whose").eqNullSafe(F.col("name"))).drop("name")
    return rows.join(blocks, F.col("owner").eqNullSafe(F.col("whose")) & (F.col("block") == F.col("above"))).withColumn(
        "steps", F.concat("steps", "high", "rest")).drop("block", "whose", "above", "high", "rest")


def op11_sql() -> str:
    fields = " || ".join(f"coalesce(strlen(cast({f} as varchar)) || ':' || {f}, '-')" for f in FIELDS)
    return f"""
WITH RECURSIVE crcs AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
docs AS MATERIALIZED (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 2 = 0 AS tampered FROM documents, crcs),
leaves AS MATERIALIZED (
  SELECT doc_id, source, sha256({fields}) AS leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN tampered THEN sha256({fields.replace("cast(text as varchar)", "replace(text, chr(10), '')").replace("|| text,", "|| replace(text, chr(10), ''),")})
      ELSE sha256({fields}) END AS seen FROM docs),
tree AS (
  SELECT 0 AS level, source, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY level, source, pos // 3),
subroots AS MATERIALIZED (SELECT source, node, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, place AS pos, node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, pos // 3),
steps AS MATERIALIZED (
  SELECT doc_id, t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.level)::BIGINT), '') AS after
  FROM leaves l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT doc_id, s.height + t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < s.place // (3 ** t.level)::BIGINT), ''),
    coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > s.place // (3 ** t.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN top t ON t.n > 1 AND t.pos // 3 = s.place // (3 ** (t.level + 1))::BIGINT
  GROUP BY doc_id, s.height, t.level),
fold AS (
  SELECT doc_id, 0 AS level, seen AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(s.before || f.node || s.after) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level),
ends AS (SELECT doc_id, arg_max(node, level) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY doc_id)
SELECT l.doc_id, leaf, s.node AS subroot, r.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN ends e ON e.doc_id = l.doc_id
LEFT JOIN proofs p ON p.doc_id = l.doc_id, (SELECT node FROM top WHERE n = 1) r"""


def verified(docs: DataFrame, tampered: Column, tampered_text: Column, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of all rows; where ``tampered``, what is folded is
    the leaf of the row with ``tampered_text`` in place of its text."""
    with scratch(docs.sparkSession):
        other = F.when(tampered & ~tampered_text.eqNullSafe(F.col("text")), leaf(docs, tampered_text))
        leaves = docs.select(F.col("source").cast("string").alias("owner"), "doc_id", leaf(docs).alias("node"), other.alias("seen"))
        leaves = stage(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")  # ties of equal rows, dealt over partitions
        rows = manifest(leaves, ["doc_id", "node", "salt"], fan, height)
        rows = rows.withColumn("folded_root", folded(F.coalesce("seen", "node"), F.col("steps")))
        return stage(rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("steps")).alias("proof_sha256"),
                                 "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "manifest", survives=True)


@query("op11_merkle", op11_sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    return verified(docs, remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
