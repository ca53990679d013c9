"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words and the end of a text.  The tree's root is the distribution of single symbols, absolutely discounted,
with the mass of discounts for all unknown words together.  Deeper nodes are contexts of any number of words.  In a
context those symbols are kept that follow it at least ``LEAST`` times, whatever the size of the corpus.  A context passes
if the distribution of what follows diverges from its suffix's by more than the cost of the parameters it adds
(G > k ln(N) / 2).  Contexts grow word by word, all of them, until no context of a length passes.

The probability of a symbol is that of the longest passing context before it: the discounted share of what is kept there;
for anything else the probability in the context's suffix (passing or not), scaled so that everything sums to one.

Words are numbered, contexts and what follows them are known by 64-bit hashes and counted in blocks by hash; nothing of
the tree is broadcast or collected.  Texts are cut into runs; at each length a run asks the blocks of its contexts about the
distinct (context, symbol) it holds, and takes back probabilities and whether contexts pass.  A position is settled once no
longer context before it can pass: if nothing is kept in its context, or the context has one follower only.  Once few
positions are left, they carry the words before their contexts along, and a block grows its contexts by up to ``STEPS`` words at once.

``fit`` and ``score`` hold a tree of contexts of one and two words that make up ``P_MIN`` of the symbols in memory, where
suffixes of states are states too; ``op8_lm`` does not use them.

A null or empty text is the end alone.  Without any training text every symbol is unknown with probability 1 and scores
are 0.  Rows are scored independently, so repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import query, remainder, table
from quadrille.llm.text import SPACED, column_bytes, hashed_words, mix
from quadrille.plans.staging import discard, scratch, shuffles_deleted, stage, width

P_MIN, BASE_DISCOUNT, STATE_DISCOUNT, ADDED = 2e-6, 0.5, 0.5, 0.1
BLOCK_BYTES, FLUSH, BATCH = 1 << 25, 1 << 21, 1 << 12
END = np.uint64(0x5D1F0E7A90C3B645)
SHIFT = np.int64(1 << 20)


def symbols(column: pa.Array):
    """(first, last, bounds, symbols) of runs of texts: hashes of the words and, after each text, the end."""
    for first, last, bounds, hashes in hashed_words(column_bytes(column), SPACED):
        yield first, last, bounds + np.arange(len(bounds)), np.insert(hashes, bounds[1:], END)


def _deal(keys: np.ndarray, blocks: int, *columns: np.ndarray):
    """(block, slices of the columns) for every block that has keys."""
    block = (keys.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    for b in np.flatnonzero(np.diff(edges)):
        at = order[edges[b]:edges[b + 1]]
        yield int(b), [c[at] for c in columns]


def count_keys(texts: DataFrame, blocks: int, keys_of) -> DataFrame:
    """(block, keys, counts) packed by block: how often ``keys_of(symbols, bounds)`` gives each key over all texts."""
    def partial(batches):
        waiting, held = [], 0
        for batch in batches:
            for _, _, bounds, found in symbols(batch.column(0)):
                keys = keys_of(found, bounds)
                waiting.append(keys)
                held += len(keys)
                if held > FLUSH:
                    yield pack(waiting)
                    waiting, held = [], 0
        if held:
            yield pack(waiting)

    def pack(waiting):
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        parts = list(_deal(keys, blocks, keys, counts))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([c[0].tobytes() for _, c in parts], pa.binary()),
                                           pa.array([c[1].astype(np.int64).tobytes() for _, c in parts], pa.binary())], names=["block", "keys", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int64)
        found, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, counts).astype(np.int64)
        return pa.table({"block": [rows["block"][0].as_py()], "keys": [found.tobytes()], "counts": [sums.tobytes()],
                         "total": [int(sums.sum())], "size": [len(sums)], "once": [int((sums == 1).sum())], "twice": [int((sums == 2).sum())]})

    return (texts.mapInArrow(partial, "block long, keys binary, counts binary").groupBy("block")
            .applyInArrow(add, "block long, keys binary, counts binary, total long, size long, once long, twice long"))


def frequent(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that occur at least ``least`` times, and their counts; there are at most N / least."""
    def pick(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                at = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(counts[at])], names=["key", "n"])

    rows = counted.select("keys", "counts").mapInArrow(pick, "key long, n long").toPandas()
    keys, counts = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def find(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, -1 where they are not in it."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == values, at, -1)


def before(ids: np.ndarray, bounds: np.ndarray, steps: int) -> np.ndarray:
    """The id that many symbols earlier in the same text, -1 at its beginning."""
    out = np.full(len(ids), -1, ids.dtype)
    out[steps:] = ids[:-steps] if steps else ids
    for k in range(steps):
        starts = bounds[:-1] + k
        out[starts[starts < len(ids)]] = -1
    return out


class Tree:
    """What is kept, and the log-probabilities of each level.  Sequences are numbers: a context's place times 2^20 plus a
    symbol's place, so at most 2^20 symbols or contexts can be told apart; P_MIN sees to that."""

    def __init__(self, total: int, kinds: int, once: int, twice: int):
        self.total, self.kinds = total, kinds
        discount = once / (once + 2 * twice) if once and twice else BASE_DISCOUNT
        self.discount = min(max(discount, 0.01), 0.99)
        self.unknown = np.log10(self.discount * kinds / total) if total else 0.0
        self.words, self.word_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pairs, self.pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.triples, self.triple_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of symbols by their counts; unknown ones have count 0."""
        if not self.total:
            return np.zeros(len(counts))
        known = np.maximum(counts - self.discount, self.discount * 1e-3) / self.total
        return np.where(counts > 0, np.log10(known), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.kinds + 1)))

    def fit(self) -> "Tree":
        """States and smoothing, from the counts of what is kept."""
        self.word_root, self.word_base = self.root(self.word_counts), self.base(self.word_counts)
        context, symbol = self.pairs // SHIFT, self.pairs % SHIFT
        self.pair_log, self.word_rest, one = self._level(context, self.pair_counts, self.word_counts, self.word_root[symbol])
        context, symbol = self.triples // SHIFT, self.triples % SHIFT
        inner = find(self.pairs, (self.pairs[context] % SHIFT) * SHIFT + symbol) if len(self.triples) else np.zeros(0, np.int64)
        below = np.where(inner >= 0, self.pair_log[inner], -30.0) if len(self.pairs) else np.zeros(0)
        self.triple_log, self.pair_rest, two = self._level(context, self.triple_counts, self.pair_counts, below)
        if len(two):
            one[self.pairs[two] % SHIFT] = True  # the suffix of a state is a state
        self.is_state_1, self.is_state_2 = one, two
        return self

    def _level(self, context, counts, context_counts, below):
        """log10 shares of what is kept, log10 scale of the rest per context, and which contexts diverge enough."""
        n = len(context_counts)
        share = (counts - STATE_DISCOUNT) / np.maximum(context_counts[context], 1)
        held, under, kept = (np.bincount(context, w, n) for w in (share, 10.0 ** below, np.ones(len(context))))
        rest = np.maximum(1 - held, 1e-12) / np.maximum(1 - under, 1e-12)
        gain = np.bincount(context, counts * (np.log(share) - np.log(10) * below), n)
        gain = gain + context_counts * np.maximum(1 - held, 1e-12) * np.log(rest)
        states = (kept > 0) & (gain > kept * np.log(max(self.total, 2)) / 2)
        return np.log10(share), np.log10(rest), states

    def score(self, found: np.ndarray, bounds: np.ndarray):
        """Per symbol its place among the kept words (-1: rare), and log10 probability without a rare symbol's root part."""
        ids = find(self.words, found)
        one = before(ids, bounds, 1)
        rare = ids < 0
        value = np.where(rare, 0.0, self.word_root[ids]) if len(self.words) else np.zeros(len(ids))
        if not len(self.words):
            return ids, value
        at = np.flatnonzero(one >= 0)
        at = at[self.is_state_1[one[at]]]
        pair = np.where(rare[at], -1, find(self.pairs, one[at] * SHIFT + ids[at]))
        value[at] = np.where(pair >= 0, self.pair_log[pair] if len(self.pairs) else 0.0, value[at] + self.word_rest[one[at]])
        two = before(ids, bounds, 2)
        at = np.flatnonzero((one >= 0) & (two >= 0))
        context = find(self.pairs, two[at] * SHIFT + one[at])
        at, context = at[context >= 0], context[context >= 0]
        at, context = at[self.is_state_2[context]], context[self.is_state_2[context]]
        triple = np.where(rare[at], -1, find(self.triples, context * SHIFT + ids[at]))
        value[at] = np.where(triple >= 0, self.triple_log[triple] if len(self.triples) else 0.0, value[at] + self.pair_rest[context])
        return ids, value


def fit(texts: DataFrame, p_min: float = P_MIN) -> tuple[Tree, DataFrame]:
    """The tree of all rows of ``texts`` (one text column), and the counts of all symbols, packed in blocks."""
    texts = texts.select(F.col(texts.columns[0]).cast("string"))
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    blocks = max(width(spark), size // BLOCK_BYTES + 1)
    counted = stage(count_keys(texts, blocks, lambda found, bounds: found), "symbol-counts")
    facts = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "size", "once", "twice")]).first()
    tree = Tree(*[int(x) for x in facts])
    tree.blocks = blocks
    if tree.total:
        least = max(2, int(np.ceil(p_min * tree.total)))
        tree.words, tree.word_counts = frequent(counted, least)
        words = spark.sparkContext.broadcast(tree.words)

        def pair_keys(found, bounds):
            ids = find(words.value, found)
            one = before(ids, bounds, 1)
            at = (ids >= 0) & (one >= 0)
            return (one[at] * SHIFT + ids[at]).astype(np.uint64)

        pairs, tree.pair_counts = frequent(count_keys(texts, blocks, pair_keys), least)
        tree.pairs = pairs.astype(np.int64)
        kept = spark.sparkContext.broadcast(tree.pairs)

        def triple_keys(found, bounds):
            ids = find(words.value, found)
            one, two = before(ids, bounds, 1), before(ids, bounds, 2)
            at = np.flatnonzero((ids >= 0) & (one >= 0) & (two >= 0))
            first, second = find(kept.value, two[at] * SHIFT + one[at]), find(kept.value, one[at] * SHIFT + ids[at])
            both = (first >= 0) & (second >= 0)
            return (first[both] * SHIFT + ids[at][both]).astype(np.uint64)

        triples, tree.triple_counts = frequent(count_keys(texts, blocks, triple_keys), least)
        tree.triples = triples.astype(np.int64)
    return tree.fit(), counted


def score(df: DataFrame, tree: Tree, counted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``df``."""
    spark = df.sparkSession
    shared, blocks = spark.sparkContext.broadcast(tree), getattr(tree, "blocks", width(spark))
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def local(batches):
        model = shared.value
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            made, rare_rows, rare_words = [], [], []
            for first, last, bounds, found in symbols(batch.column(2)):
                at, value = model.score(found, bounds)
                count = np.diff(bounds)
                owner = np.repeat(np.arange(first, last), count)
                rare = at < 0
                known = ~rare
                base = np.where(known, model.word_base[at] if len(model.words) else 0.0, 0.0)
                add = lambda w: np.add.reduceat(w, bounds[:-1])
                made.append((count, add(known.astype(np.int64)), add(base), add(value)))
                rare_rows.append(rows[owner[rare]])
                rare_words.append(found[rare])
            if made:
                edges = np.concatenate([np.flatnonzero(np.diff(batch_of(rows), prepend=-1)), [len(rows)]])
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x)
                         for x in (rows, ids, *[np.concatenate(x) for x in zip(*made)])]
                nothing = pa.nulls(len(edges) - 1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(batch_of(rows[edges[:-1]]) % blocks), nothing, nothing, *lists], names=names)
                keys, owners = np.concatenate(rare_words), np.concatenate(rare_rows)
                parts = list(_deal(keys, blocks, keys, owners))
                empty = [pa.nulls(len(parts), t) for t in types[3:]]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int64()), pa.array([c[0].tobytes() for _, c in parts], pa.binary()),
                                                  pa.array([c[1].tobytes() for _, c in parts], pa.binary())] + empty, names=names)

    id_type = _arrow(source.schema["id"].dataType)
    names = ["block", "words", "rows", "row", "id", "n_tokens", "n_known", "base", "value"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()),
             pa.list_(pa.float64()), pa.list_(pa.float64())]
    parts = source.mapInArrow(local, f"block long, words binary, rows binary, row array<long>, id array<{kind}>, n_tokens array<long>, "
                                     "n_known array<long>, base array<double>, value array<double>")

    def look_up(parts: pa.Table, counts: pa.Table) -> pa.Table:
        model = shared.value
        keys = np.frombuffer(b"".join(counts["keys"].to_pylist()), np.uint64)
        numbers = np.frombuffer(b"".join(counts["counts"].to_pylist()), np.int64)
        words = np.frombuffer(b"".join(parts["words"].drop_null().to_pylist()), np.uint64)
        owner, place = np.unique(np.frombuffer(b"".join(parts["rows"].drop_null().to_pylist()), np.int64), return_inverse=True)
        at = find(keys, words)
        n = np.where(at >= 0, numbers[at] if len(numbers) else 0, 0)
        add = lambda w: np.bincount(place, w, len(owner))
        columns = [owner, add(n > 0).astype(np.int64), add(model.base(n)).astype(float), add(model.root(n)).astype(float)]
        batch = batch_of(owner)
        edges = np.flatnonzero(np.diff(batch, prepend=-1))
        out = [[c[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(owner)])] for c in columns]
        sums = pa.table({"batch": pa.array(batch[edges], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(packed, out)},
                         **{n: pa.nulls(len(edges), t) for n, t in zip(names[3:], types[3:])}})
        whole = parts.filter(parts["words"].is_null())
        first = [batch_of(np.array([r[0].as_py()]))[0] for r in whole["row"]]
        local = pa.table({"batch": pa.array(first, pa.int64()), **{n: pa.nulls(len(whole), pa.binary()) for n in packed},
                          **{n: whole[n].cast(t) for n, t in zip(names[3:], types[3:])}})
        return pa.concat_tables([sums, local])

    def total(rows: pa.Table) -> pa.Table:
        whole = rows.filter(rows["row"].is_valid())
        row, known, base, value = [_flat(whole[n], t).to_numpy() for n, t in
                                   (("row", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("value", pa.float64()))]
        order = np.argsort(row)
        owner, more, base_more, value_more = [np.frombuffer(b"".join(rows[n].drop_null().to_pylist()), k) for n, k in
                                              zip(packed, (np.int64, np.int64, float, float))]
        at = order[np.searchsorted(row[order], owner)] if len(owner) else np.zeros(0, np.int64)
        add = lambda w: np.bincount(at, w, len(row))
        return pa.table({"doc_id": _flat(whole["id"], id_type), "n_tokens": _flat(whole["n_tokens"], pa.int64()),
                         "n_known": known + add(more).astype(np.int64), "base_score": base + add(base_more), "score": value + add(value_more)})

    packed = ["rows", "found", "base_more", "value_more"]
    nested = "row array<long>, id array<{}>, n_tokens array<long>, n_known array<long>, base array<double>, value array<double>".format(kind)
    found = parts.groupBy("block").cogroup(counted.select("block", "keys", "counts").groupBy("block")).applyInArrow(
        look_up, f"batch long, {', '.join(n + ' binary' for n in packed)}, {nested}")
    return found.groupBy("batch").applyInArrow(total, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def batch_of(rows: np.ndarray) -> np.ndarray:
    """Number of the run of BATCH rows of one partition that a row is in; row numbers hold the partition above bit 33."""
    return rows // BATCH


def _flat(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    parts = [c.flatten() for c in column.chunks]
    return pa.concat_arrays(parts).cast(kind) if parts else pa.nulls(0, kind)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


# --- the whole tree, in blocks ------------------------------------------------------

LEAST, RUN, SHARE_BYTES = 2, 1 << 19, 1 << 23
STEPS, SLICES = 16, 2
ROOM, ASKED, WORD = 7, 11, 2  # bytes: what requests may take per position of the texts, what one takes, and each further word of it
ODD = np.uint64(0x9E3779B97F4A7C15)
PASSES, GOES_ON, KEPT = 1, 2, 4
_PARTS = {"bounds": np.int64, "train": np.bool_, "words": np.uint64, "number": np.int64, "count": np.int64, "place": np.int32, "at": np.uint8,
          "node": np.float32, "value": np.float32, "known": np.int64, "base": np.float64, "score": np.float64}
_SUMS = tuple(f"sum{k}" for k in range(STEPS))


def _packed(values: np.ndarray, kind) -> bytes:
    """Bytes of equal weight side by side, compressed; the size first."""
    data = np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def _unpacked(data: bytes, kind) -> np.ndarray:
    size, item = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, -1).T).view(kind).ravel()


def _all(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[_unpacked(x, kind) for x in column.to_pylist()]])


def _row(table: pa.Table | pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    part = {n: _unpacked(table[n][i].as_py(), k) for n, k in _PARTS.items()}
    value = np.where(np.isnan(part["value"]), part["node"], part["value"])
    return part | {"value": value, "at": np.flatnonzero(np.unpackbits(part["at"], count=len(part["place"])))}


def _with(rows, parts: list[dict[str, np.ndarray]], **facts) -> pa.Table:
    """The runs of ``rows`` with new parts.  Values that are their positions' nodes are left out."""
    columns = {n: rows[n] for n in ("run", "ids", "held")}
    parts = [p | {"at": _bits(p["at"], len(p["place"])), "value": np.where(p["value"] == p["node"], np.float32(np.nan), p["value"])} for p in parts]
    columns |= {n: pa.array([_packed(p[n], k) for p in parts], pa.binary()) for n, k in _PARTS.items()}
    return pa.table(columns | {n: pa.array(v, pa.int64()) for n, v in facts.items()})


def _bits(at: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size, bool)
    marks[at] = True
    return np.packbits(marks)


def _sums(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums per text of values at some positions."""
    return np.bincount(np.searchsorted(bounds, at, "right") - 1, values, len(bounds) - 1)


def _steps(active: int, many: int) -> int:
    """By how many words contexts may grow at once if ``active`` of ``many`` positions are left."""
    return min(max((ROOM * many - ASKED * active) // (WORD * active) + 1, 1), STEPS)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a hash, which follows from its upper 24 bits and grows with them."""
    return ((keys >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)


def _trained(part: dict[str, np.ndarray]) -> np.ndarray:
    return part["train"][np.searchsorted(part["bounds"], part["at"], "right") - 1]


def _exchange(state: DataFrame, blocks: int, ask, serve, answer: list, steps: int = 1):
    """Each run asks blocks about its distinct keys.  ``ask(part)`` gives the place of every position among the distinct keys, and
    arrays, by the first of which keys are dealt into blocks and ordered (upper 24 bits); ``serve(arrays)`` answers all that one
    block is asked.  Returns the staged answers and the blocks' sums."""
    kinds = [np.uint64, np.int64, np.int32, np.float32] + [np.int64] * (steps - 1)
    names = [f"k{k}" for k in range(len(kinds))]

    def requests(batches):
        for batch in batches:
            for i, run in enumerate(batch.column(0).to_pylist()):
                _, arrays = ask(_row(batch, i))
                edges = np.searchsorted(_block(arrays[0], blocks), np.arange(blocks + 1))
                full = np.flatnonzero(np.diff(edges))
                data = [pa.array([_packed(c[edges[b]:edges[b + 1]], t) for b in full], pa.binary()) for c, t in zip(arrays, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([run] * len(full), pa.int64()), *data],
                                                 names=["block", "run", *names])

    def replies(rows: pa.Table) -> pa.Table:
        arrays = [_all(rows[n], k) for n, k in zip(names, kinds)]
        edges = np.concatenate([[0], np.cumsum([int.from_bytes(x[:8], "little") // 8 for x in rows[names[0]].to_pylist()])])
        made, sums = serve(arrays)
        data = {f"r{k}": pa.array([_packed(c[a:b], t) for a, b in zip(edges, edges[1:])], pa.binary())
                for k, (c, t) in enumerate(zip(made, answer))}
        first = np.arange(len(rows)) == 0
        sums = [*sums, *[0] * (len(_SUMS) - len(sums))]
        return pa.table({"block": rows["block"], "run": rows["run"], **data, **{n: pa.array(np.where(first, s, 0), pa.int64()) for n, s in zip(_SUMS, sums)}})

    asked = state.mapInArrow(requests, "block long, run long, " + ", ".join(n + " binary" for n in names))
    replied = stage(asked.groupBy("block").applyInArrow(
        replies, "block long, run long, " + ", ".join(f"r{k} binary" for k in range(len(answer))) + "".join(f", {n} long" for n in _SUMS)), "answers")
    return replied, [int(x or 0) for x in replied.agg(*[F.sum(n) for n in _SUMS]).first()]


def _merge(state: DataFrame, replied: DataFrame, ask, take, answer: list) -> tuple[DataFrame, int]:
    """Each run takes in what it was answered: ``take(part, place, answers)`` gives the new part and how many positions are
    active.  Runs go in slices, so that only one slice of them is shuffled at a time.  The old runs and the answers are deleted."""
    def merge(rows: pa.Table, back: pa.Table) -> pa.Table:
        part = _row(rows, 0)
        place, _ = ask(part)
        back = back.sort_by("block")
        new, active = take(part, place, [_all(back[f"r{k}"], t) for k, t in enumerate(answer)])
        return _with(rows, [new], active=[active])

    kept = state.select("run", "ids", "held", *_PARTS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + ", active long"
    merged = None
    for k in range(SLICES):
        runs, back = (df.filter(F.pmod(F.xxhash64("run"), F.lit(SLICES)) == k) for df in (kept, replied.drop(*_SUMS)))
        one = stage(runs.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(merge, schema), "runs")
        merged = one if merged is None else merged.union(one)
    discard(state)
    discard(replied)
    return merged, merged.agg(F.sum("active")).first()[0] or 0


def _runs(docs: DataFrame) -> DataFrame:
    """Texts as runs of about RUN symbols: distinct words, and for each position the place of its word."""
    kind = _arrow(docs.schema["id"].dataType)

    def pack(batches):
        from pyspark import TaskContext
        run = TaskContext.get().partitionId() << 33
        waiting, held = [], 0
        for batch in batches:
            for first, last, bounds, found in symbols(batch.column(3)):
                waiting.append((batch.slice(first, last - first), np.diff(bounds), found))
                held += len(found)
                if held >= RUN:
                    yield whole(waiting, run)
                    waiting, held, run = [], 0, run + 1
        if waiting:
            yield whole(waiting, run)

    def whole(waiting, run):
        texts = pa.Table.from_batches([w[0] for w in waiting]).combine_chunks()
        words, place, often = np.unique(np.concatenate([w[2] for w in waiting]), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # small numbers for frequent words pack best
        words, place = words[order], np.argsort(order)[place]
        sizes = np.concatenate([w[1] for w in waiting])
        n, one = len(sizes), lambda c, t: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks().cast(t))
        part = {k: np.zeros(0, t) for k, t in _PARTS.items()} | {
            "bounds": np.concatenate([[0], np.cumsum(sizes)]), "train": texts["train"].to_numpy(), "words": words, "place": place,
            "known": np.zeros(n), "base": np.zeros(n), "score": np.zeros(n)}
        rows = {"run": pa.array([run], pa.int64()), "ids": one(texts["id"], kind), "held": one(texts["held"], pa.bool_())}
        return _with(rows, [part]).to_batches()[0]

    name = docs.schema["id"].dataType.simpleString()
    return stage(docs.select("id", "held", "train", "t").mapInArrow(
        pack, f"run long, ids array<{name}>, held array<boolean>, " + ", ".join(n + " binary" for n in _PARTS)), "runs")


def score_by_growing(df: DataFrame, train: F.Column, held: F.Column, doc_id: str = "doc_id", text: str = "text",
                     deepest: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows with ``train`` are learned."""
    spark = df.sparkSession
    with scratch(spark), shuffles_deleted(spark):
        docs = df.select(F.col(f"`{doc_id}`").alias("id"), held.cast("boolean").alias("held"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.col(f"`{text}`").cast("string").alias("t"))
        blocks = max(width(spark), (docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SHARE_BYTES + 1)
        state = _runs(docs)
        replied, known = _exchange(state, blocks, _ask_words, _serve_words(blocks), [np.int64, np.int64])
        state, active = _merge(state, replied, _ask_words, _take_words(known[:4]), [np.int64, np.int64])
        known, passed, length = known[:4], True, 1
        total, many = known[0], active
        while active and passed and (deepest is None or length <= deepest):
            steps = _steps(active, many)
            if deepest is not None:
                steps = min(steps, deepest - length + 1)
            while True:
                ask, answer = _ask_contexts(length, known, steps), [np.float32, np.uint8] + [np.float32] * (steps > 1)
                replied, sums = _exchange(state, blocks, ask, _serve_contexts(total, steps), answer, steps)
                none = sums[:steps].index(0) if 0 in sums[:steps] else steps  # growth ends at the first length at which no context passes
                if not any(sums[none:steps]):
                    break
                steps = none + 1
                discard(replied)
            state, active = _merge(state, replied, ask, _take_contexts(length, known, steps), answer)
            passed, length = none == steps, length + steps
        kind = state.schema["ids"].dataType.elementType

        def unpack(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    part = _row(batch, i) if length > 1 else _opened(_row(batch, i), 1, known)
                    score = part["score"] + _sums(part["value"], part["at"], part["bounds"])
                    sizes = np.diff(part["bounds"])
                    yield pa.RecordBatch.from_arrays([batch["ids"][i].values, batch["held"][i].values, pa.array(sizes), pa.array(part["known"]),
                                                      pa.array(np.full(len(sizes), total)), pa.array(part["base"]), pa.array(score)], names=out)

        out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return stage(state.mapInArrow(unpack, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                              "base_score double, score double"), "scores", survives=True)


def _ask_words(part):
    train = np.repeat(part["train"], np.diff(part["bounds"]))
    words, n = part["words"], np.bincount(part["place"], train, len(part["words"])).astype(np.int32)
    order = np.argsort(words, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return place, [words[order], np.zeros(len(words), np.int64), n[order], np.zeros(len(words), np.float32)]


def _serve_words(blocks: int):
    def serve(arrays):
        """The words' counts, and their numbers: small ones for frequent words, as these pack best."""
        place, words = pd.factorize(arrays[0])
        sums = np.bincount(place, arrays[2]).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.argsort(-sums, kind="stable")] = np.arange(len(words)) * blocks + _block(words[:1], blocks)
        return [sums[place], number[place]], [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]
    return serve


def _take_words(facts: list[int]):
    def take(part, place, answers):
        model, bounds = Tree(*facts), part["bounds"]
        counts, number = (a[place] for a in answers)
        place = part["place"]
        every, goes = np.arange(len(place)), _opens(part | {"count": counts})
        value = np.where(goes, 0.0, model.root(counts)[place])
        return part | {"words": part["words"][:0], "number": number, "count": counts, "known": _sums(counts[place] > 0, every, bounds),
                       "base": _sums(model.base(counts)[place], every, bounds), "score": _sums(value, every, bounds)}, int(goes.sum())
    return take


def _opens(part) -> np.ndarray:
    """Which positions have a context of one word that occurs often enough; every text has its end at least."""
    goes = np.ones(len(part["place"]), bool)
    goes[part["bounds"][:-1]] = False
    goes[1:] &= part["count"][part["place"][:-1]] >= LEAST
    return goes


def _opened(part, length: int, facts: list[int]):
    """The part with its active positions; those of one word start from the words' counts."""
    if length == 1:
        at = np.flatnonzero(_opens(part))
        node = Tree(*facts).root(part["count"]).astype(np.float32)[part["place"][at]]
        part = part | {"at": at, "node": node, "value": node}
    return part


def _longer(context: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hashes of contexts with one more word before them."""
    return mix(context + number.astype(np.uint64) * ODD)


def _ask_contexts(length: int, facts: list[int], steps: int):
    def ask(part):
        """Equal positions (of the words asked about) stand side by side when sorted by some bits of their hashes, above their own numbers."""
        part = _opened(part, length, facts)
        at, place, number = part["at"], part["place"], part["number"]
        context, tail, further = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), []
        for k in range(1, length + 1):
            context = _longer(context, number[place[at - k]])
        if steps > 1:
            start = part["bounds"][np.searchsorted(part["bounds"], at, "right") - 1]
        for k in range(length + 1, length + steps):
            further.append(np.where(at - k >= start, number[place[at - k]], -1))
            tail = _longer(tail, further[-1])
        symbol, low = place[at], np.uint64((1 << max(len(at) - 1, 0).bit_length()) - 1)
        bits = mix(tail + symbol.astype(np.uint64) * ODD) >> np.uint64(24)
        order = (np.sort((context >> np.uint64(40) << np.uint64(40)) | (bits & ~low) | np.arange(len(at), dtype=np.uint64)) & low).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = False
        for column in (context, symbol, tail) if steps > 1 else (context, symbol):
            ordered = column[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        found = np.empty(len(at), np.int64)
        found[order] = np.cumsum(new) - 1
        n, first = np.bincount(found, _trained(part)).astype(np.int32), order[new]
        return found, [context[first], number[symbol[first]], n, part["node"][first], *[f[first] for f in further]]
    return ask


def _serve_contexts(total: int, steps: int):
    def level(contexts, words, n, below):
        """A length's probability of each asked symbol in its context, and whether the context passes, and may have longer ones that do."""
        place, after = pd.factorize(mix(contexts * ODD + mix(words.astype(np.uint64))))
        first = np.empty(len(after), np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        counts = np.bincount(place, n)
        context, _ = pd.factorize(contexts[first])
        below = below[first].astype(float)
        occurs = np.bincount(context, counts)
        keep = counts >= LEAST
        share = np.where(keep, (counts - STATE_DISCOUNT) / np.maximum(occurs[context], 1), 1.0)
        held, under, kept = (np.bincount(context, np.where(keep, w, 0)) for w in (share, 10.0 ** below, 1))
        rest = np.maximum(1 - held, 1e-12) / np.maximum(1 - under, 1e-12)
        gain = np.bincount(context, np.where(keep, counts * (np.log(share) - np.log(10) * below), 0.0))
        gain = gain + occurs * np.maximum(1 - held, 1e-12) * np.log(rest)
        passes = (kept > 0) & (gain > kept * np.log(max(total, 2)) / 2)
        # A context with one follower only: what it gains by growing is below log(occurs) / 2, so nothing longer passes.
        sure = np.bincount(context, keep & (counts == occurs[context])) > 0
        node = np.where(keep, np.log10(share), below + np.log10(rest)[context]).astype(np.float32)
        flags = passes[context] * PASSES + ((kept > 0) & ~sure)[context] * GOES_ON + keep * KEPT
        return node[place], flags.astype(np.uint8)[place]

    def serve(arrays):
        """Nodes and flags of the last length, and values of the longest one that passes, if there are several."""
        contexts, words, n, below, *further = arrays
        live, passed = np.arange(len(contexts)), []
        value, flags = np.zeros(len(live), np.float32), np.full(len(live), KEPT, np.uint8)
        node = value.copy()
        for k in range(steps):
            if k:
                goes = (found & GOES_ON > 0) & (further[k - 1][live] >= 0)
                live, contexts, below = live[goes], contexts[goes], below[goes]
                contexts = _longer(contexts, further[k - 1][live])
            if not len(live):
                break
            below, found = level(contexts, words[live], n[live], below)
            passes = found & PASSES > 0
            value[live[passes]] = below[passes]
            flags[live[passes]] |= PASSES
            passed.append(int(passes.sum()))
        if len(live):
            node[live] = np.where(found & (GOES_ON | PASSES) > 0, below, 0)
            flags[live] = (found & ~np.uint8(PASSES)) | (flags[live] & PASSES)
        return [node, flags, value][:2 + (steps > 1)], passed
    return serve


def _take_contexts(length: int, facts: list[int], steps: int):
    def take(part, place, answers):
        part = _opened(part, length, facts)
        node, flags, passed = answers[0][place], answers[1][place], answers[-1][place] if len(answers) > 2 else answers[0][place]
        at, bounds = part["at"], part["bounds"]
        value = np.where(flags & PASSES, passed, part["value"]).astype(np.float32)
        start = bounds[np.searchsorted(bounds, at, "right") - 1]
        before = np.concatenate([[-1], at[:-1]])
        once = np.concatenate([[False], flags[:-1] & KEPT == 0]) & (before == at - 1)  # the longer context occurs once
        goes = (flags & GOES_ON > 0) & (at - length - steps >= start) & ~once
        return part | {"count": part["count"][:0], "at": at[goes], "node": node[goes], "value": value[goes],
                       "score": part["score"] + _sums(value[~goes], at[~goes], bounds)}, int(goes.sum())
    return take


@query("op8_lm")
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    return score_by_growing(docs, ~held_out, held_out)
