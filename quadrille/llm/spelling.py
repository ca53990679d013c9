"""Spelling variants: words one edit away from a word that is at least twice as frequent.

Words are counted inside tasks and summed.  The vocabulary's words are found near each other by generated edits, probed
against broadcast blocked Bloom filters, one shard per word length (and per part of a length with many words).  Words
of length n probe the filter of n with one code point exchanged for a larger one, and that of n - 1 with one deleted, so
every pair is met once.  An edit's hash follows from the word's, a sum of random values of (position, code point), by
subtracting and adding; no edited word is written out unless its filter says yes.  Those positives are joined with the
vocabulary, which removes false ones and yields the exact pairs.

Filters are built where the words are, and travel in rounds of at most ``ROUND_WORDS`` words (two bytes each), so what is
broadcast does not grow with the vocabulary; the rounds' number does.  Edits use the code points that the vocabulary has.

Null and empty texts have no words.  A null id never changes a run.  Repeated rows count as often as they stand.  Of equally
frequent near words the smallest in code-point order is the form.  Forms are at least twice as frequent, so following them
ends; pointers are doubled until it has.  An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import query, table
from quadrille.llm.text import LOWER_AZ, column_bytes, mix
from quadrille.plans.staging import scratch, stage

LEAST_LENGTH, LEAST_COUNT, TYPO_OF, FORM_TIMES = 5, 3, 97, 2
ROUND_WORDS, PART_WORDS = 1 << 24, 1 << 20
FLUSH, PROBES = 1 << 18, 1 << 20
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # UTF-8 of a to z and of U+00C0 to U+00FF, A-Z being lower-cased before
_SALTS = np.random.RandomState(20240612).randint(1, 1 << 31, 8).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_LANES, _SLOT = 8, 16  # words of 32 bits in a filter's block, and how many keys a block is meant for


# --- words ---------------------------------------------------------------------------

def counts_of(ids: list, texts: list[bytes | None], total: Counter, changed: int = TYPO_OF) -> Counter:
    """Adds the words of some texts to ``total``; of runs whose hash ``changed`` divides, a code point goes (0: none)."""
    for doc, text in zip(ids, texts):
        if not text:
            continue
        found = Counter(_RUN.findall(text.translate(LOWER_AZ)))
        if doc is not None and changed:
            start = zlib.crc32(b"%d:" % doc)
            for word in [w for w in found if zlib.crc32(w, start) % changed == 0]:
                n, letters = found.pop(word), word.decode()
                at = zlib.crc32(word, start) % len(letters)
                total[(letters[:at] + letters[at + 1:]).encode()] += n
        total.update(found)
    return total


def word_counts(docs: DataFrame, doc_id: str, text: str, changed: int = TYPO_OF, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of ``length`` code points that occur ``least`` times."""
    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), column_bytes(batch.column(1))
            for at in range(0, len(ids), 256):
                counts_of(ids[at:at + 256], texts[at:at + 256], total, changed)
                if len(total) > FLUSH:
                    yield flush(total)
                    total.clear()
        yield flush(total)

    counted = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "word string, n long")
    return counted.filter(F.length("word") >= length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- hashes of words and of their edits ----------------------------------------------

def _value(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A random value of a position and a code point below 256."""
    return mix(place.astype(np.uint64) * np.uint64(256) + letter.astype(np.uint64) + np.uint64(1))


def letters_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def hashes_of(letters: np.ndarray) -> np.ndarray:
    """Hashes of words of one length, before the finaliser, a word a row."""
    return _value(np.arange(letters.shape[1]), letters).sum(1, dtype=np.uint64)


def deleted(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, position, hash) of all distinct words with one code point less; of a run of one code point its first goes."""
    n, length = letters.shape
    here, moved = _value(np.arange(length), letters), _value(np.arange(length) - 1, letters)  # the first is never moved
    ahead = np.cumsum(here, 1) - here
    behind = np.cumsum(moved[:, ::-1], 1)[:, ::-1] - moved
    first = np.ones((n, length), bool)
    first[:, 1:] = letters[:, 1:] != letters[:, :-1]
    word, at = np.nonzero(first)
    return word, at, (ahead + behind)[word, at]


def exchanged(letters: np.ndarray, hashes: np.ndarray, alphabet: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, letter, hash) of all words with a larger code point of ``alphabet`` at a position."""
    there = np.full(len(alphabet), place)
    base = hashes - _value(np.full(len(letters), place), letters[:, place])
    word, letter = np.nonzero(alphabet[None, :] > letters[:, place][:, None])
    return word, alphabet[letter], base[word] + _value(there, alphabet)[letter]


# --- blocked Bloom filters -----------------------------------------------------------

def blocks_for(keys: int) -> int:
    return max(1, -(-keys // _SLOT))


def _lanes(hashes: np.ndarray, lane: int) -> np.ndarray:
    low = hashes.astype(np.uint32)
    return np.uint32(1) << ((low * _SALTS[lane]) >> np.uint32(27))


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def filter_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """A filter of ``blocks`` blocks of 256 bits: a key sets a bit in each of its block's eight words."""
    bits, block = np.zeros((blocks, _LANES), np.uint32), _block(hashes, blocks)
    for lane in range(_LANES):
        np.bitwise_or.at(bits[:, lane], block, _lanes(hashes, lane))
    return bits


def probe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes that may be in the filter."""
    at, block = np.arange(len(hashes)), _block(hashes, len(bits))
    for lane in range(_LANES):
        held = _lanes(hashes[at], lane)
        at = at[bits[block[at], lane] & held != 0]
    return at


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of its length's words a (finalised) hash belongs to."""
    return mix(hashes) % np.uint64(parts)


# --- pairs of near words -------------------------------------------------------------

def _hashed(vocabulary: DataFrame) -> DataFrame:
    """length, part hash and letters' hash of every word."""
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            h = np.zeros(len(words), np.uint64)
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                step = max(1, PROBES // int(size))
                for a in range(0, len(rows), step):
                    h[rows[a:a + step]] = mix(hashes_of(letters_of([words[i] for i in rows[a:a + step]], int(size))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h.view(np.int64))], names=["word", "length", "h"])
    return vocabulary.select("word").mapInArrow(run, "word string, length long, h long")


def _rounds(sizes: dict[int, int], round_words: int, part_words: int) -> Iterator[list[tuple[int, int, int]]]:
    """Shards (length, part, parts), grouped so that a round's words stay within ``round_words``."""
    now, held = [], 0
    for length in sorted(sizes):
        parts = -(-sizes[length] // part_words)
        for part in range(parts):
            each = sizes[length] / parts
            if now and held + each > round_words:
                yield now
                now, held = [], 0
            now.append((length, part, parts))
            held += each
    if now:
        yield now


def _filters(hashed: DataFrame, shards: list[tuple[int, int, int]], sizes: dict[int, int]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of some shards, each built by one task of its at most about ``PART_WORDS`` words."""
    parts = {length: n for length, _, n in shards}
    wanted = {(length, part) for length, part, _ in shards}

    def deal(batches):
        for batch in batches:
            length, h = batch["length"].to_numpy(), batch["h"].to_numpy().view(np.uint64)
            part = np.zeros(len(h), np.uint64)
            for size in np.unique(length):
                if size in parts:
                    part[length == size] = part_of(h[length == size], parts[size])
            keep = np.array([(int(a), int(b)) in wanted for a, b in zip(length, part)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(length[keep]), pa.array(part[keep].astype(np.int64)), pa.array(h[keep].view(np.int64))], names=["length", "part", "h"])

    def build(rows: pa.Table) -> pa.Table:
        length, part = rows["length"][0].as_py(), rows["part"][0].as_py()
        bits = filter_of(rows["h"].to_numpy().view(np.uint64), blocks_for(-(-sizes[length] // parts[length])))
        return pa.table({"length": [length], "part": [part], "bits": pa.array([bits.tobytes()], pa.binary())})

    lengths = sorted({length for length, _ in wanted})
    dealt = hashed.filter(F.col("length").between(lengths[0], lengths[-1])).select("length", "h").mapInArrow(deal, "length long, part long, h long")
    built = dealt.groupBy("length", "part").applyInArrow(build, "length long, part long, bits binary")
    return {(r["length"], r["part"]): np.frombuffer(r["bits"], np.uint32).reshape(-1, _LANES) for r in built.collect()}


def _positives(hashed: DataFrame, filters, shards: list[tuple[int, int, int]], sizes: dict[int, int], alphabet: str) -> DataFrame:
    """(word, other): edits of words that one of the filters takes for a word."""
    parts = {length: n for length, _, n in shards}
    letters_used = np.frombuffer(alphabet.encode("latin-1"), np.uint8)

    def hit(held, length: int, hashes: np.ndarray) -> np.ndarray:
        if parts[length] == 1:
            bits = held.get((length, 0))
            return probe(bits, hashes) if bits is not None else np.zeros(0, np.int64)
        part, found = part_of(hashes, parts[length]), []
        for k in np.unique(part):
            bits = held.get((length, int(k)))
            if bits is not None:
                rows = np.flatnonzero(part == k)
                found.append(rows[probe(bits, hashes[rows])])
        return np.concatenate([np.zeros(0, np.int64), *found])

    def edits(held, words: list[str], length: int) -> Iterator[tuple[str, str]]:
        letters = letters_of(words, length)
        if length - 1 in parts:
            word, at, h = deleted(letters)
            for k in hit(held, length - 1, mix(h)):
                w, i = words[word[k]], at[k]
                yield w, w[:i] + w[i + 1:]
        if length in parts and sizes[length] > 1:
            whole = hashes_of(letters)
            for i in range(length):
                word, letter, h = exchanged(letters, whole, letters_used, i)
                for k in hit(held, length, mix(h)):
                    w = words[word[k]]
                    yield w, w[:i] + chr(letter[k]) + w[i + 1:]

    def run(batches):
        held = filters.value
        for batch in batches:
            words, length = batch["word"].to_pylist(), batch["length"].to_numpy()
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                step = max(1, PROBES // max(int(size), len(letters_used)))
                for a in range(0, len(rows), step):
                    pairs = edits(held, [words[i] for i in rows[a:a + step]], int(size))
                    yield from _batches(pairs)

    lengths = sorted({length for length, _, _ in shards})
    return hashed.filter(F.col("length").between(lengths[0], lengths[-1] + 1)).select("word", "length").mapInArrow(run, "word string, other string")


def _batches(pairs: Iterator[tuple[str, str]], size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str]] = []
    for pair in pairs:
        held.append(pair)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.string()) for k in (0, 1)], names=["word", "other"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in held], pa.string()) for k in (0, 1)], names=["word", "other"])


def near_pairs(vocabulary: DataFrame, round_words: int = ROUND_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """(word, other), once for each pair of words of ``vocabulary`` (word; distinct, code points below 256) that are near."""
    spark = vocabulary.sparkSession
    hashed = stage(_hashed(vocabulary), "hashed")
    sizes = {r["length"]: r["count"] for r in hashed.groupBy("length").count().collect()}  # a row for each length
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # 90 at most
    found = None
    for shards in _rounds(sizes, round_words, part_words):
        filters = spark.sparkContext.broadcast(_filters(hashed, shards, sizes))
        positives = _positives(hashed, filters, shards, sizes, alphabet)
        exact = positives.join(vocabulary.select(F.col("word").alias("other")), "other", "left_semi").select("word", "other")
        exact = stage(exact, "near")
        filters.destroy()
        found = exact if found is None else found.union(exact)
    return found if found is not None else vocabulary.select("word", F.col("word").alias("other")).limit(0)


def variants(counted: DataFrame, times: int = FORM_TIMES, round_words: int = ROUND_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``counted`` (word, n).  Call it inside ``scratch``."""
    counted = stage(counted, "words")
    pairs = near_pairs(counted, round_words, part_words)
    both = pairs.union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    beside = both.join(counted.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other")))
    beside = beside.groupBy("word").agg(best.alias("best"), F.count(F.lit(1)).alias("n_near"))
    joined = counted.join(beside, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                         F.col("best.other").alias("other"), (-F.col("best.less")).alias("m"))
    enough = F.col("m") >= times * F.col("n")
    formed = stage(joined.select("word", "n", "n_near", F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("m")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` ends.  Each round sends on a word whose pointer's target has a form itself."""
    ends = forms.join(forms.select(F.col("word").alias("form")), "form", "left_anti")
    done = stage(ends.select("word", F.col("form").alias("root")), "ended")
    going = stage(forms.join(forms.select(F.col("word").alias("form")), "form", "left_semi").select("word", F.col("form").alias("to")), "going")
    while going.limit(1).count():
        ended = going.join(done.select(F.col("word").alias("to"), "root"), "to").select("word", "root")
        further = going.join(going.select(F.col("word").alias("to"), F.col("to").alias("next")), "to").select("word", F.col("next").alias("to"))
        done, going = done.union(stage(ended, "ended")), stage(further, "going")
    return done


def spelling(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", changed: int = TYPO_OF, length: int = LEAST_LENGTH, least: int = LEAST_COUNT,
             times: int = FORM_TIMES, round_words: int = ROUND_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    with scratch(docs.sparkSession):
        counted = word_counts(docs, doc_id, text, changed, length, least)
        return stage(variants(counted, times, round_words, part_words), "spelling", survives=True)


OP12_SQL = """
WITH RECURSIVE crcs AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h FROM runs, crcs),
counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:(h % len(run))::INT] || run[(h % len(run))::INT + 2:] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM counted WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS cut FROM (SELECT word, n, unnest(range(len(word)))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word AND len(a.word) = len(b.word)
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.cut),
beside AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT b.word, n_near, m, min(other) AS other FROM beside b JOIN pairs p USING (word, m) GROUP BY ALL),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS last, form AS next FROM forms UNION ALL SELECT way.word, f.word, f.form FROM way JOIN forms f ON f.word = way.next)
SELECT f.word, form, last AS root, n, n_near, form_n FROM forms f JOIN way ON way.word = f.word AND way.next IS NULL"""


@query("op12_spelling", OP12_SQL)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling(table(spark, sf_dir, "documents").select("doc_id", "text"))
