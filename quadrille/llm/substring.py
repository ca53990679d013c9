"""Substring dedup over words: fixed-block anchors, rolling probes, and extension to maximal exact repeats.

A passage of ``WIDTH`` words, wherever it starts, holds exactly one whole block of ``(WIDTH + 1) // 2`` words of its
document's own division into blocks.  So documents are indexed by their non-overlapping blocks only, and every rolling window
of a block's length probes that index.  A probe hits if the block is one of a document with a smaller id.  Hits, and the
blocks that were hit, are extended: all windows of ``WIDTH`` words around a hit are compared with those around the blocks, and
overlapping equal windows join up to the maximal repeats.  A word that such a repeat covers is removed, if the repeat also
stands in a document with a smaller id; repeats within one document stay.

Texts travel as runs of about ``RUN_BYTES``.  A run asks for each distinct block or window once, however often it has it, so a
passage in a third of all documents is one request a run.  Requests are dealt by hash and packed; at sizes where a run has
about one request for a task they are as many rows as distinct windows, not more.  Two exchanges happen: blocks against
rolling probes, then windows around hits.  Blocks are compared by 64 bits, which only decides what is extended; windows by 128.

Null and empty texts, and texts of fewer than ``WIDTH`` words, lose nothing.  A row without an id loses nothing and is no
reference.  Rows of one id are one document: none is smaller than the other.  A run holds whole texts, so memory grows with
the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import query, table
from quadrille.llm.lm import _packed as packed
from quadrille.llm.lm import _unpacked as unpacked
from quadrille.llm.text import SPACED, _cut, column_bytes, hash_chunk, mix
from quadrille.plans.staging import discard, scratch, shuffles_deleted, stage, width

WIDTH = 13
RUN_BYTES, SHARE_BYTES = 1 << 22, 1 << 23
NONE = np.iinfo(np.int64).max
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Run:
    """Some texts as hashes of words, with everything that the exchanges ask about."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes], size: int):
        self.size, self.block = size, (size + 1) // 2
        self.words, self.bounds = word_hashes(texts)
        sizes = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.id = ids[self.doc]
        self.place = np.arange(len(self.words)) - self.bounds[self.doc]
        self.left = np.where(known & (sizes >= size), sizes, 0)[self.doc] - self.place  # words from here to the end, where they count

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rolling blocks, the distinct hashes, and each place's number among those."""
        at = np.flatnonzero(self.left >= self.block)
        hashes, number = np.unique(rolled(self.words, self.block, _ODD)[at], return_inverse=True)
        return at, hashes, number

    def index(self, at: np.ndarray, hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per hash: the least id that has it as a block of its own, and whether two ids have it here."""
        least, low, high = np.full(len(hashes), NONE), np.full(len(hashes), NONE), np.full(len(hashes), -NONE - 1)
        own = self.place[at] % self.block == 0
        np.minimum.at(least, number[own], self.id[at[own]])
        np.minimum.at(low, number, self.id[at])
        np.maximum.at(high, number, self.id[at])
        return least, low != high

    def around(self, at: np.ndarray, hit: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a hit, or whose own block was ``found``."""
        n = len(self.words)
        flags = np.zeros(n + self.block + 1, np.int64)
        flags[at[hit] + 1] = 1
        upto = np.cumsum(flags)
        starts = np.flatnonzero(self.left >= self.size)
        held = upto[starts + self.block] > upto[starts]
        own = np.zeros(n + self.block, bool)
        own[at[found]] = True
        return starts[held | own[starts + (-self.place[starts]) % self.block]]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows as two hashes, each start's number among those, and the least id with it here."""
        one, two = rolled(self.words, self.size, _ODD)[starts], rolled(mix(self.words ^ _OTHER), self.size, _OTHER)[starts]
        first, number = distinct(one, two)
        least = np.full(len(first), NONE)
        np.minimum.at(least, number, self.id[starts])
        return one[first], two[first], number, least


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, piece in _cut(b"\n".join(texts), SPACED):
        start, _, h = hash_chunk(piece, SPACED)
        starts.append(start + at)
        hashes.append(h)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def rolled(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of the ``size`` words from each place on, where there are as many."""
    n = max(len(words) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * base + words[k:k + n]
    return mix(h)


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct pairs, in order, and every pair's number among them."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


# --- runs ----------------------------------------------------------------------------

_RUN = "run long, ids binary, known binary, sizes binary, texts binary"


def runs(docs: DataFrame, run_bytes: int) -> DataFrame:
    """Rows (id long, t string) as one row for about ``run_bytes`` of text; a size of -1 is a null text."""
    def whole(run, ids, texts) -> pa.RecordBatch:
        data = [packed(np.array([i or 0 for i in ids], np.int64), np.int64), packed(np.array([i is not None for i in ids], bool), np.bool_),
                packed(np.array([-1 if t is None else len(t) for t in texts], np.int64), np.int64), packed_text(texts)]
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), *[pa.array([d], pa.binary()) for d in data]],
                                          names=["run", "ids", "known", "sizes", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        run, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 1
                if held >= run_bytes:
                    yield whole(run, ids, texts)
                    run, ids, texts, held = run + 1, [], [], 0
        if ids:
            yield whole(run, ids, texts)

    return docs.mapInArrow(gather, _RUN)


def packed_text(texts: list[bytes | None]) -> bytes:
    data = b"".join([t or b"" for t in texts])
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def opened(rows, i: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Ids, whether they are known, and texts of a row of ``runs``."""
    ids, known, sizes = (unpacked(rows[n][i].as_py(), t) for n, t in (("ids", np.int64), ("known", np.bool_), ("sizes", np.int64)))
    ends = np.cumsum(np.maximum(sizes, 0))
    data = rows["texts"][i].as_py()
    data = pa.decompress(data, int(ends[-1]), codec="zstd", asbytes=True) if data else b""
    return ids, known, [None if s < 0 else data[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())]


def run_of(rows, i: int, size: int) -> Run:
    ids, known, texts = opened(rows, i)
    return Run(ids, known, [t or b"" for t in texts], size)


# --- exchanges -----------------------------------------------------------------------

def exchange(state: DataFrame, blocks: int, ask: Callable, take: Callable, schema: str) -> DataFrame:
    """Each run learns, for its distinct keys that other runs have too, the least id over all runs.

    ``ask(rows, i)`` gives a run's distinct keys, two arrays of hashes, and the least id it has itself (NONE: it only asks).
    ``take(rows, least)`` makes the rows of the result; ``least`` is NONE where no other run has the key.
    """
    def dealt(rows, i: int):
        one, two, least = ask(rows, i)
        block = (one % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((two, one, least == NONE, block))
        return one[order], two[order], least[order], order, np.searchsorted(block[order], np.arange(blocks + 1))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, run in enumerate(batch["run"].to_pylist()):
                one, two, least, _, edges = dealt(batch, i)
                full = np.flatnonzero(np.diff(edges))
                parts = [(one[a:b], two[a:b] if two.any() else two[:0], least[a:b][least[a:b] < NONE]) for a, b in zip(edges[full], edges[full + 1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), run), pa.int64()),
                     *[pa.array([packed(p[k], t) for p in parts], pa.binary()) for k, t in enumerate((np.uint64, np.uint64, np.int64))]],
                    names=["block", "run", "one", "two", "least"])

    def replies(rows: pa.Table) -> pa.Table:
        ones = [unpacked(x, np.uint64) for x in rows["one"].to_pylist()]
        twos = [unpacked(x, np.uint64) for x in rows["two"].to_pylist()]
        own = [np.concatenate([k, np.full(len(o) - len(k), NONE)]) for o, k in zip(ones, (unpacked(x, np.int64) for x in rows["least"].to_pylist()))]
        one, two = np.concatenate(ones), np.concatenate([t if len(t) else np.zeros(len(o), np.uint64) for o, t in zip(ones, twos)])
        first, number = distinct(one, two)
        least = np.full(len(first), NONE)
        np.minimum.at(least, number, np.concatenate(own))
        told = (np.bincount(number, minlength=len(first)) > 1) & (least < NONE)
        out, at = [], 0
        for run, o in zip(rows["run"].to_pylist(), ones):
            mine = number[at:at + len(o)]
            at += len(o)
            places = np.flatnonzero(told[mine])
            if len(places):
                out.append((run, packed(places, np.int32), packed(least[mine[places]], np.int64)))
        block = rows["block"][0].as_py()
        return pa.table({"block": pa.array([block] * len(out), pa.int64()), "run": pa.array([o[0] for o in out], pa.int64()),
                         "at": pa.array([o[1] for o in out], pa.binary()), "least": pa.array([o[2] for o in out], pa.binary())})

    def merge(rows: pa.Table, back: pa.Table) -> pa.Table:
        rows = rows.to_batches()[0]
        one, _, _, order, edges = dealt(rows, 0)
        found = np.full(len(one), NONE)
        for block, at, least in zip(*[back[n].to_pylist() for n in ("block", "at", "least")]):
            found[order[edges[block] + unpacked(at, np.int32)]] = unpacked(least, np.int64)
        return take(rows, found)

    asked = state.mapInArrow(requests, "block long, run long, one binary, two binary, least binary")
    replied = stage(asked.groupBy("block").applyInArrow(replies, "block long, run long, at binary, least binary"), "replies")
    return state.groupBy("run").cogroup(replied.groupBy("run")).applyInArrow(merge, schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WIDTH, run_bytes: int = RUN_BYTES,
            share_bytes: int = SHARE_BYTES, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """doc_id, n_words, spans (the removed words: start and length of each stretch) and kept (the other words, joined by a
    blank) of every row; ``finish`` may reduce that before it is written."""
    spark = docs.sparkSession

    def ask_blocks(rows, i):
        run = run_of(rows, i, size)
        at, hashes, number = run.probes()
        return hashes, np.zeros(len(hashes), np.uint64), run.index(at, hashes, number)[0]

    def take_blocks(rows, found):
        run = run_of(rows, 0, size)
        at, hashes, number = run.probes()
        least, both = run.index(at, hashes, number)
        shared = both | (found < NONE)
        hit = np.where(shared, np.minimum(least, found), NONE)[number] < run.id[at]
        starts = run.around(at, hit, shared[number] & (run.place[at] % run.block == 0))
        flags = np.zeros(len(run.words), bool)
        flags[starts] = True
        return pa.table({n: rows[n] for n in rows.schema.names} | {"starts": pa.array([packed(np.packbits(flags), np.uint8)], pa.binary())})

    def marked(rows, i):
        run = run_of(rows, i, size)
        flags = np.unpackbits(unpacked(rows["starts"][i].as_py(), np.uint8), count=len(run.words))
        return run, np.flatnonzero(flags)

    def ask_windows(rows, i):
        run, starts = marked(rows, i)
        one, two, _, least = run.windows(starts)
        return one, two, least

    def take_windows(rows, found):
        run, starts = marked(rows, 0)
        _, _, number, least = run.windows(starts)
        gone = starts[np.minimum(least, found)[number] < run.id[starts]]
        edge = np.zeros(len(run.words) + size + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + size, -1)
        cover = np.cumsum(edge)[:len(run.words)] > 0
        ids, known, texts = opened(rows, 0)
        spans, kept = [], []
        for text, a, b in zip(texts, run.bounds.tolist(), run.bounds[1:].tolist()):
            change = np.flatnonzero(np.diff(np.concatenate([[False], cover[a:b], [False]]).astype(np.int8)))
            spans.append([{"start": s, "length": e - s} for s, e in zip(change[::2].tolist(), change[1::2].tolist())])
            words = (text or b"").split()
            kept.append(b" ".join(compress(words, (~cover[a:b]).tolist()) if len(change) else words))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": pa.array(np.diff(run.bounds), pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    with scratch(spark), shuffles_deleted(spark):
        rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
        blocks = max(width(spark), (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // share_bytes + 1)
        state = stage(runs(rows, run_bytes), "runs")
        probed = stage(exchange(state, blocks, ask_blocks, take_blocks, _RUN + ", starts binary"), "probed")
        discard(state)
        result = exchange(probed, blocks, ask_windows, take_windows, "doc_id long, n_words long, spans array<struct<start:long,length:long>>, kept string")
        return stage(finish(result), "repeats", survives=True)


OP13_SQL = r"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (win) WHERE least < doc_id),
kept AS (
  SELECT d.doc_id, string_agg(word, ' ' ORDER BY d.p) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs) d ANTI JOIN gone USING (doc_id, p) GROUP BY d.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


@query("op13_substring", OP13_SQL)
def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), finish=lambda rows: rows.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")))
