"""Set-similarity join of documents over word n-grams, as a blocked sparse matrix product.

The incidence matrix has a row per distinct set and a column per n-gram; the product with its transpose holds the
overlaps.  It is computed in blocks of columns, and only in those that can matter:

* Two sets with Jaccard similarity of at least t overlap in t times the larger size, so under any common order of the
  columns they share one of their first ``n - ceil(t n) + 1``.  Rows are cut to that prefix.
* Columns are ordered by their hashes, but columns that are frequent among the prefixes come last.  Which ones are is
  found in rounds: count the prefixes' columns, move the frequent ones to the end, cut the prefixes anew.  A sharing
  n-gram of a passage that stands in many texts thus drops out of all prefixes but those of texts made of such passages.
  Any set of frequent columns gives the same result; it is kept to ``MAX_HOT`` columns, and broadcast.
* A block accumulates the overlap counts of its rows' pairs; sums over blocks are compared with the bound that the two
  sizes give, and pairs that cannot reach the threshold are discarded.  The others are counted exactly.

Pairs within frequent columns are not emitted.  Each such column has a pivot, the row made most of frequent columns;
rows are compared with their pivots, and the links so far are joined to components.  Rows that are then outside the
largest component of a column's rows are multiplied, in blocks of bounded size, with all rows around the same pivot, and
one link to every other component is kept.  No link between components is lost; links inside one are not needed.

Equal sets are one row from the start.  Sets travel as sorted 64-bit hashes; where some are equal, a table of the distinct
ones is written, which every round reads.  A set's own hash is 64 bits as well.

Null and empty texts have the empty set and are linked with nothing.  Rows may repeat an id: each row gets its own line,
and the component's id is the least id in it.  Null ids are kept; they never are a component's id unless it has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, free_name, query, table
from quadrille.llm.components import connected
from quadrille.llm.text import SPACED, column_bytes, hashed_words, mix
from quadrille.plans.staging import discard, scratch, shuffles_deleted, small_batches, stage, width

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: A column is frequent if more than HOT prefixes hold it; at most MAX_HOT columns count as frequent; rounds of counting.
HOT, MAX_HOT, ROUNDS = 64, 1 << 20, 8
#: Entries of a block of columns, entries a task holds before it passes them on, rows that may be broadcast as ids.
BLOCK_ENTRIES, FLUSH, MAX_IDS = 1 << 18, 1 << 18, 1 << 22
#: Bytes of sets or texts that are worked on at once, and rows that are read or passed to Python at once.
SLICE, BATCH_ROWS = 1 << 20, 400
#: Pairs that are counted exactly in one group, whose sets are in memory together.
GROUP_PAIRS = 4000
#: Rows of a block of the product within frequent columns.
ROWS_LEFT, ROWS_RIGHT = 512, 2048
_rng = np.random.RandomState(5)
_MULTIPLIERS = _rng.randint(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of all words as one run if there are fewer, but some."""
    run = min(size, len(words))
    if not run:
        return np.zeros(0, np.uint64)
    n = len(words) - run + 1
    total = np.full(n, np.uint64(run))
    for k in range(run):
        total += words[k:k + n] * _MULTIPLIERS[k % 64]
    return np.unique(mix(total))


def set_table(df: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """tag (a row number), doc_id, n, node (the set's hash, null for the empty set) and hashes of every row; written."""
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches):
        for batch in slices(batches, 1):
            texts, ids = column_bytes(batch.column(1)), batch.column(0)
            sizes, nodes, sets = [], [], []
            for first, last, bounds, hashes in hashed_words(texts, SPACED):
                for k in range(last - first):
                    s = shingles(hashes[bounds[k]:bounds[k + 1]], words)
                    sizes.append(len(s))
                    nodes.append(node_of(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                             names=["doc_id", "n", "node", "hashes"])

    kind = source.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, n long, node long, hashes binary")
    return stage(made.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "n", "node", "hashes"), "sets")


def node_of(s: np.ndarray) -> int | None:
    """The hash of a set, null for the empty one."""
    return int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None


def _nodes(texts: list[bytes | None]) -> list[list[int | None]]:
    return [[node_of(shingles(hashes[bounds[k]:bounds[k + 1]], WORDS)) for first, last, bounds, hashes in hashed_words(texts, SPACED)
             for k in range(last - first)]]


def prefix_length(n, numerator: int, denominator: int):
    """Entries of a set of n among which any partner shares one."""
    return n - (numerator * n + denominator - 1) // denominator + (n > 0)


def members(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a binary column, and where each row starts (and the last ends)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64), np.concatenate([[0], np.cumsum([len(r) // 8 for r in rows])]).astype(np.int64)


def slices(batches, column: int):
    """Consecutive parts of batches with about SLICE bytes in a binary column each, but at least one row."""
    for batch in batches:
        offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset:][:batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def prefixes(tokens, bounds, hot, numerator, denominator):
    """Flags of the entries in the prefixes, of frequent entries, and the row of every entry."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    length = prefix_length(size, numerator, denominator)
    is_hot = members(tokens, hot)
    cold_before = np.concatenate([[0], np.cumsum(~is_hot)])
    place = np.arange(len(tokens)) - bounds[:-1][row]
    cold_rank = cold_before[:-1] - cold_before[bounds[:-1]][row]
    colds = cold_before[bounds[1:]] - cold_before[bounds[:-1]]
    taken = np.where(is_hot, colds[row] + place - cold_rank, cold_rank) < length[row]
    return taken, is_hot, row


def _packed(columns: list[np.ndarray], blocks: int, names: list[str]) -> pa.RecordBatch:
    """Arrays (hashes first) dealt into blocks of columns, as one row of bytes per block."""
    block = (columns[0] % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    full = np.flatnonzero(np.diff(edges))
    data = [pa.array([c[order[edges[b]:edges[b + 1]]].tobytes() for b in full], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64())] + data, names=["block", *names])


def _unpacked(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows[name].to_pylist()), kind)


class Join:
    """One run of the join over a written table of sets."""

    def __init__(self, sets: DataFrame, numerator: int, denominator: int):
        self.spark, self.sizes = sets.sparkSession, sets.select("doc_id", "n", "node")
        self.numerator, self.denominator = numerator, denominator
        thin = sets.filter("n > 0").select("tag", "doc_id", "node", "n")
        self.nodes = stage(thin.groupBy("node").agg(F.min("tag").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("rows")), "nodes")
        several = self.nodes.filter("rows > 1").select("node", "rep")
        facts = self.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("rows") > 1).alias("several"), F.sum("rows").alias("rows")).first()
        self.rows = sets.filter("n > 0").select("tag", "n", "hashes")
        if facts["several"]:  # one row per distinct set is written: every round reads the rows
            copies = thin.join(self._small(several, facts["several"]), "node").filter("tag <> rep").select("tag")
            self.rows = stage(self.rows.join(self._small(copies, facts["rows"] - facts["nodes"]), "tag", "left_anti"), "distinct")
            self.sizes = stage(self.sizes, "sizes")
            discard(sets)
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        share = 1 - numerator / denominator
        self.blocks = max(width(self.spark), int(total * share) // BLOCK_ENTRIES + 1)
        self.hot = self._frequent()

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        """Broadcast up to MAX_IDS rows of ids; a shuffled join beyond."""
        return F.broadcast(df) if rows <= MAX_IDS else df

    def _frequent(self) -> np.ndarray:
        """Hashes of the frequent columns, sorted; rounds of counting over all prefixes."""
        hot, blocks, top, low = np.zeros(0, np.uint64), self.blocks, self.numerator, self.denominator
        for _ in range(ROUNDS):
            shared = self.spark.sparkContext.broadcast(hot)

            def entries(batches, shared=shared):
                waiting, held = [], 0
                for batch in slices(batches, 0):
                    tokens, bounds = flat(batch.column(0))
                    taken, is_hot, _ = prefixes(tokens, bounds, shared.value, top, low)
                    waiting.append(tokens[taken & ~is_hot])
                    held += len(waiting[-1])
                    if held > FLUSH:
                        yield _packed([*np.unique(np.concatenate(waiting), return_counts=True)], blocks, ["tokens", "counts"])
                        waiting, held = [], 0
                if held:
                    yield _packed([*np.unique(np.concatenate(waiting), return_counts=True)], blocks, ["tokens", "counts"])

            def add(rows: pa.Table) -> pa.Table:
                tokens, counts = _unpacked(rows, "tokens", np.uint64), _unpacked(rows, "counts", np.int64)
                found, place = np.unique(tokens, return_inverse=True)
                sums = np.bincount(place, counts)
                return pa.table({"token": found[sums > HOT].view(np.int64), "rows": sums[sums > HOT].astype(np.int64)})

            frequent = stage(self.rows.select("hashes").mapInArrow(entries, "block long, tokens binary, counts binary")
                             .groupBy("block").applyInArrow(add, "token long, rows long"), "frequent")
            room = MAX_HOT - len(hot)
            new = frequent.orderBy(F.desc("rows"), "token").limit(room).select("token").toPandas()["token"].to_numpy(np.int64)
            if not len(new):
                break
            hot = np.union1d(hot, new.view(np.uint64))
        return hot

    def cold_pairs(self) -> DataFrame:
        """Pairs (a, b) of rows that share an infrequent column of their prefixes and pass the bound of their sizes."""
        shared, blocks, top, low = self.spark.sparkContext.broadcast(self.hot), self.blocks, self.numerator, self.denominator

        def entries(batches):
            waiting, held = [], 0
            for batch in slices(batches, 2):
                tokens, bounds = flat(batch.column(2))
                taken, is_hot, row = prefixes(tokens, bounds, shared.value, top, low)
                hots = np.bincount(row[taken & is_hot], minlength=len(bounds) - 1)
                cold = taken & ~is_hot
                at = row[cold]
                waiting.append((tokens[cold], batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at].astype(np.int32), hots[at].astype(np.int32)))
                held += len(at)
                if held > FLUSH // 2:
                    yield _packed([np.concatenate(x) for x in zip(*waiting)], blocks, ["tokens", "tags", "sizes", "hots"])
                    waiting, held = [], 0
            if held:
                yield _packed([np.concatenate(x) for x in zip(*waiting)], blocks, ["tokens", "tags", "sizes", "hots"])

        def multiply(rows: pa.Table) -> pa.Table:
            tokens, tags = _unpacked(rows, "tokens", np.uint64), _unpacked(rows, "tags", np.int64)
            sizes, hots = _unpacked(rows, "sizes", np.int32), _unpacked(rows, "hots", np.int32)
            _, group, count = np.unique(tokens, return_inverse=True, return_counts=True)
            keep = count[group] > 1
            group, tags, sizes, hots = group[keep], tags[keep], sizes[keep], hots[keep]
            order = np.lexsort((tags, group))
            group, tags, sizes, hots = group[order], tags[order], sizes[order].astype(np.int64), hots[order]
            left, right = [], []
            alive = np.arange(len(group))
            for step in range(1, len(group)):
                alive = alive[alive + step < len(group)]
                alive = alive[group[alive] == group[alive + step]]
                if not len(alive):
                    break
                a, b = alive, alive + step
                near = np.minimum(sizes[a], sizes[b]) * low >= np.maximum(sizes[a], sizes[b]) * top
                left.append(a[near])
                right.append(b[near])
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            b = np.concatenate(right) if right else np.zeros(0, np.int64)
            order = np.lexsort((tags[b], tags[a]))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (tags[a][1:] != tags[a][:-1]) | (tags[b][1:] != tags[b][:-1])])) if len(a) else a
            shares = np.diff(np.concatenate([first, [len(a)]])) if len(a) else a
            a, b = a[first], b[first]
            return pa.table({"a": tags[a], "b": tags[b], "na": sizes[a].astype(np.int32), "nb": sizes[b].astype(np.int32),
                             "extra": np.minimum(hots[a], hots[b]), "c": shares.astype(np.int32)})

        packed = self.rows.select("tag", "n", "hashes").mapInArrow(
            entries, "block long, tokens binary, tags binary, sizes binary, hots binary")
        counted = packed.groupBy("block").applyInArrow(multiply, "a long, b long, na int, nb int, extra int, c int")
        sums = counted.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").cast("long").alias("na"),
                                             F.first("nb").cast("long").alias("nb"), F.first("extra").alias("extra"))
        rest = [F.col(n) - (F.col(n) - F.floor((self.numerator * F.col(n) + self.denominator - 1) / self.denominator) + 1) for n in ("na", "nb")]
        reach = F.col("c") + F.col("extra") + F.greatest(*rest)
        total = self.numerator + self.denominator
        return sums.filter(total * reach >= self.numerator * (F.col("na") + F.col("nb"))).select("a", "b")

    def sets_of(self, needs: DataFrame) -> DataFrame:
        """(group, tag, hashes) for needs (group, tag); the table of sets is not shuffled unless the needs are many."""
        tags = needs.select("tag").distinct()
        n = tags.count()
        source = self.rows.select("tag", "hashes")
        if n <= MAX_IDS:
            source = source.join(F.broadcast(tags), "tag", "left_semi")
        return source.join(needs, "tag")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), distinct, whose sets are similar enough, counted exactly.  Pairs meet where most of a pair's
        neighbours are: at the least row that either side is paired with, dealt on by the rows if those are many."""
        pairs = stage(pairs, "pairs")
        n = pairs.count()
        both = pairs.union(pairs.select("b", "a"))
        lead = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("lead"))
        placed = (pairs.join(lead.withColumnRenamed("lead", "la"), "a")
                  .join(lead.select(F.col("a").alias("b"), F.col("lead").alias("lb")), "b")
                  .select("a", "b", F.least("la", "lb").alias("lead")))
        load = placed.groupBy("lead").agg(F.ceil(F.sqrt(F.count("*") / GROUP_PAIRS)).alias("cuts"))
        cut = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
        groups = max(width(self.spark), n // GROUP_PAIRS + 1)
        placed = stage(placed.join(load, "lead").select("a", "b", F.pmod(F.xxhash64("lead", cut("a"), cut("b")), F.lit(groups)).alias("group")), "placed")
        needs = stage(placed.select("group", F.col("a").alias("tag")).union(placed.select("group", F.col("b").alias("tag"))).distinct(), "needs")
        top, low = self.numerator, self.denominator

        def count(pairs: pa.Table, sets: pa.Table) -> pa.Table:
            known = {t: np.frombuffer(h, np.uint64) for t, h in zip(sets["tag"].to_pylist(), sets["hashes"].to_pylist())}
            kept = []
            for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
                x, y = known[a], known[b]
                small, big = (x, y) if len(x) < len(y) else (y, x)
                overlap = int(members(small, big).sum())
                if low * overlap >= top * (len(x) + len(y) - overlap):
                    kept.append((a, b))
            return pa.table({"a": pa.array([k[0] for k in kept], pa.int64()), "b": pa.array([k[1] for k in kept], pa.int64())})

        return placed.groupBy("group").cogroup(self.sets_of(needs).groupBy("group")).applyInArrow(count, "a long, b long")

    def hot_entries(self) -> DataFrame:
        """(token, tag, n, worth) for every frequent column in a prefix; worth: the share of frequent columns in the row."""
        shared, top, low = self.spark.sparkContext.broadcast(self.hot), self.numerator, self.denominator

        def entries(batches):
            for batch in slices(batches, 2):
                tokens, bounds = flat(batch.column(2))
                taken, is_hot, row = prefixes(tokens, bounds, shared.value, top, low)
                size = np.diff(bounds)
                worth = np.bincount(row[is_hot], minlength=len(size)) * 1000 // np.maximum(size, 1)
                at = np.flatnonzero(taken & is_hot)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), batch.column(0).take(pa.array(row[at])),
                                                  pa.array(size[row[at]]), pa.array(worth[row[at]])], names=["token", "tag", "n", "worth"])

        return self.rows.select("tag", "n", "hashes").mapInArrow(entries, "token long, tag long, n long, worth long")

    def around_pivots(self) -> tuple[DataFrame, DataFrame]:
        """(pivot, tag, n) of the rows around each pivot, distinct; and pairs of rows with their pivots."""
        entries = stage(self.hot_entries(), "hot")
        pivots = entries.groupBy("token").agg(F.max(F.struct("worth", "n", "tag")).alias("p"))  # at most MAX_HOT rows
        around = stage(entries.join(F.broadcast(pivots.select("token", F.col("p.tag").alias("pivot"), F.col("p.n").alias("pn"))), "token")
                       .select("pivot", "pn", "tag", "n").distinct(), "around")
        near = F.least("n", "pn") * self.denominator >= F.greatest("n", "pn") * self.numerator
        pairs = around.filter(near & (F.col("tag") != F.col("pivot"))).select(
            F.least("tag", "pivot").alias("a"), F.greatest("tag", "pivot").alias("b")).distinct()
        return around.select("pivot", "tag", "n"), pairs

    def across(self, around: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between rows around one pivot that lie in different components so far."""
        at = around.join(roots.withColumnRenamed("node", "tag"), "tag", "left").withColumn("root", F.coalesce("root", "tag"))
        at = stage(at, "around-roots")
        parts = at.groupBy("pivot", "root").agg(F.count("*").alias("size"))
        main = parts.groupBy("pivot").agg(F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("parts"), F.sum("size").alias("rows"))
        split = stage(main.filter("parts > 1").select("pivot", F.col("m.root").alias("main"), (F.col("rows") - F.col("m.size")).alias("left"), "rows"), "split")
        if split.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        cuts = at.join(split, "pivot")
        lefts = F.ceil(F.col("left") / ROWS_LEFT)
        rights = F.ceil(F.col("rows") / ROWS_RIGHT)
        row_cut = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "tag"), count)
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
        left = (cuts.filter("root <> main").withColumn("i", row_cut(lefts, 1)).withColumn("j", every(rights))
                .select("pivot", "i", "j", "tag", "root", F.lit(True).alias("is_left")))
        right = (cuts.withColumn("j", row_cut(rights, 2)).withColumn("i", every(lefts))
                 .select("pivot", "i", "j", "tag", "root", F.lit(False).alias("is_left")))
        needs = stage(left.union(right), "needs")
        tags = needs.select("tag").distinct()
        source = self.rows.select("tag", "hashes")
        if tags.count() <= MAX_IDS:
            source = source.join(F.broadcast(tags), "tag", "left_semi")
        top, low = self.numerator, self.denominator

        def product(rows: pa.Table) -> pa.Table:
            is_left = rows["is_left"].to_numpy()
            left, right = rows.filter(pa.array(is_left)), rows.filter(pa.array(~is_left))
            found = []
            if len(left) and len(right):
                tags, roots = left["tag"].to_numpy(), left["root"].to_numpy()
                tokens, bounds = flat(left["hashes"].combine_chunks())
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(tokens, kind="stable")
                owner = owner[order]
                names, starts, counts = np.unique(tokens[order], return_index=True, return_counts=True)
                best: dict[tuple[int, int], int] = {}
                for tag, root, data in zip(right["tag"].to_pylist(), right["root"].to_pylist(), right["hashes"].to_pylist()):
                    row = np.frombuffer(data, np.uint64)
                    at = np.searchsorted(names, row)
                    at[at == len(names)] = 0
                    at = at[names[at] == row]
                    spread = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(counts[at])[:-1]]), counts[at])
                    overlap = np.bincount(owner[spread + np.arange(len(spread))], minlength=len(sizes))
                    similar = (low * overlap >= top * (sizes + len(row) - overlap)) & (roots != root)
                    for k in np.flatnonzero(similar):
                        key = (int(tags[k]), root)
                        best[key] = min(tag, best.get(key, tag))
                found = [(t, x) for (t, _), x in best.items()]
            return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

        return source.join(needs, "tag").groupBy("pivot", "i", "j").applyInArrow(product, "a long, b long")

    def links(self) -> DataFrame:
        """Links between rows (tags of the first row with a set) that join every component of the similarity graph."""
        pairs = self.cold_pairs()
        if not len(self.hot):
            return self.linked(pairs)
        around, pivot_pairs = self.around_pivots()
        links = stage(self.linked(pairs.union(pivot_pairs).distinct()), "linked")
        return links.union(self.across(around, connected(links)))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, numerator: int = NUMERATOR,
               denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _components(df, doc_id, text, words, numerator, denominator).drop("node")


def _components(df: DataFrame, doc_id: str, text: str, words: int, numerator: int, denominator: int) -> DataFrame:
    """doc_id, node, n_shingles and component_id of every row."""
    with scratch(df.sparkSession), shuffles_deleted(df.sparkSession), small_batches(df.sparkSession, BATCH_ROWS):
        sets = set_table(df, doc_id, text, words)
        join = Join(sets, numerator, denominator)
        roots = connected(join.links())
        nodes = join.nodes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        nodes = nodes.select("node", "low", F.coalesce("root", "rep").alias("root"), "rows")
        lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("members"))
        named = stage(nodes.join(lows, "root").filter("members > 1").select("node", "component_id"), "named")
        named = F.broadcast(named) if named.count() <= MAX_IDS // 2 else named
        return stage(join.sizes.join(named, "node", "left").select(
            "doc_id", "node", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components", survives=True)


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with the least id.  Rows without words or without an id stay, but
    of rows that are equal in id and text only one does."""
    gone, again, node = free_name(df, "gone"), free_name(df, "again"), free_name(df, "node")
    found = _components(df, doc_id, text, WORDS, NUMERATOR, DENOMINATOR)
    beaten = found.filter("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias(gone), "node")
    least = stage(beaten.select(gone).distinct(), gone)
    least = F.broadcast(least) if least.count() <= MAX_IDS else least
    several = stage(found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again)), again)
    n = several.count()
    if not n:
        return df.join(least, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
    several = F.broadcast(several) if n <= MAX_IDS else several
    same = F.col(f"`{doc_id}`") == F.col(again)
    once = df.join(several, same, "left_anti").join(least, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
    # Rows that share their id with others go by id and set.
    rows = df.join(several, same, "left_semi").withColumn(node, F.col(f"`{text}`").cast("string"))
    rows = extend(rows, node, [T.StructField(node, T.LongType())], _nodes, binary=True)
    beaten = beaten.withColumnRenamed("node", again).distinct()
    rows = rows.join(beaten, (F.col(f"`{doc_id}`") == F.col(gone)) & (F.col(node) == F.col(again)), "left_anti")
    return once.union(rows.dropDuplicates([doc_id, text]).select(*[F.col(f"`{c}`") for c in df.columns]))


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
