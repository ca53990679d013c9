"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark items.

Normalising lower-cases A-Z and keeps words (runs of digits, ASCII letters and characters beyond ASCII).  Every word of
the benchmark's vocabulary becomes one symbol and every other word a separator, so a text is scanned once, a symbol a
word, and a match's place is at once the place of words in the original.  A window is ``width`` consecutive words of an
item; an item with fewer words, but not none, is one window.

The items travel to the executors in blocks of at most ``BLOCK_WORDS`` words, one broadcast a block.  A benchmark of
more than one block is scanned block by block, the hits so far being carried with the rows and staged in between.

Null texts and texts without words have no hits and are not contaminated.  Rows are independent; repeated rows give
repeated results.  Items that share an id count as one item; items without an id hit words but are not counted.  An
empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import free_name, query, table
from quadrille.llm.text import ALNUM, LOWER_AZ
from quadrille.plans.staging import stage

WIDTH = 13
BLOCK_WORDS = 1 << 20
#: Lower-cases, and turns every separator into a blank.
_TO_WORDS = bytes(LOWER_AZ[b] if ALNUM[LOWER_AZ[b]] else 32 for b in range(256))
_built: dict[str, tuple[dict, ahocorasick.Automaton, list]] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def _symbol(i: int) -> str:
    return chr(0x100 + i if 0x100 + i < 0xD800 else 0x900 + i)  # surrogates are left out


def build(items: list[tuple[str | None, list[bytes]]], width: int):
    """Symbols of the vocabulary, the automaton (or None), and ids by place."""
    symbols: dict[bytes, str] = {}
    patterns: dict[str, set[int]] = {}
    for place, (_, words) in enumerate(items):
        text = "".join([symbols.setdefault(w, _symbol(len(symbols))) for w in words])
        for at in range(max(1, len(text) - width + 1) if text else 0):
            patterns.setdefault(text[at:at + width], set()).add(place)
    automaton = ahocorasick.Automaton()
    for text, places in patterns.items():
        automaton.add_word(text, (len(text), tuple(places)))
    automaton.make_automaton()
    return symbols, automaton if patterns else None, [i for i, _ in items]


def match(words: list[bytes], built) -> tuple[list[int], set[str]]:
    """Hit words as a flat list of disjoint [start, end) pairs, and the ids of items with an occurring window."""
    symbols, automaton, ids = built
    if automaton is None or not words:
        return [], set()
    get = symbols.get
    text = "".join([get(w, " ") for w in words])
    spans, found = [], set()
    for last, (length, places) in automaton.iter(text):
        spans.append((last + 1 - length, last + 1))
        found.update(places)
    return merge(spans), {ids[p] for p in found if ids[p] is not None}


def merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    for row in rows.toLocalIterator():  # a partition at a time; a block holds at most BLOCK_WORDS words and one item
        words = words_of(bytes(row["t"]) if row["t"] is not None else None)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield block


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         width: int = WIDTH) -> DataFrame:
    """``df`` plus n_words, hit_spans (word places, flat [start, end) pairs) and hit_items (ids, sorted as strings).

    Columns of ``df`` with these names are replaced.
    """
    made = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())),
            T.StructField("hit_items", T.ArrayType(T.StringType()))]
    names = {f.name for f in made}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    work = free_name(df, "scanned_text")
    out, spark = df, df.sparkSession
    blocks = 0
    for block in _blocks(benchmark, item_id, item_text):
        if blocks:
            out = stage(out, "scanned")
        shared = spark.sparkContext.broadcast(block)
        out = _scan_block(out, df.columns, text, work, made, shared, width, first=blocks == 0)
        blocks += 1
    if not blocks:
        shared = spark.sparkContext.broadcast([])
        out = _scan_block(out, df.columns, text, work, made, shared, width, first=True)
    return out


def _scan_block(df, carried, text, work, made, shared, width, first) -> DataFrame:
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("binary").alias(work),
                       *([] if first else [F.col(f.name) for f in made]))
    schema = T.StructType([df.schema[c] for c in carried] + made)
    n, key = len(carried), uuid.uuid4().hex

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = build(shared.value, width)
        built = _built[key]
        for batch in batches:
            counts, spans, items = [], [], []
            earlier = None if first else (batch.column(n + 2), batch.column(n + 3))
            for k, value in enumerate(batch.column(n)):
                words = words_of(value.as_py())
                hit, ids = match(words, built)
                if earlier is not None:
                    old = earlier[0][k].as_py()
                    hit = merge(list(zip(hit[::2], hit[1::2])) + list(zip(old[::2], old[1::2])))
                    ids |= set(earlier[1][k].as_py())
                counts.append(len(words))
                spans.append(hit)
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                                                       pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return source.mapInArrow(run, schema)


def contamination(scanned: DataFrame) -> DataFrame:
    """Exchanges hit_spans and hit_items for n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"),
                      lambda a, x: a + x)
    return scanned.withColumns({
        "n_hit": hit, "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("hit_items", ",").cast("binary"), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("hit_spans", "hit_items")


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not contaminated, with the columns of ``df``."""
    names = {c: free_name(df, "kept_" + c) for c in df.columns}
    renamed = df.select(*[F.col(f"`{c}`").alias(v) for c, v in names.items()])
    clean = contamination(scan(renamed, benchmark, names[text])).filter("not contaminated")
    return clean.select(*[F.col(v).alias(c) for c, v in names.items()])


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH items AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, s.size, i, array_to_string(w[i:i + s.size - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM windows) s
  WHERE i + s.size - 1 <= len(w)),
hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.size = v.size AND p.win = v.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query("op6_decontaminate", SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    scanned = contamination(scan(docs, table(spark, sf_dir, "benchmark"), text="doc_text"))
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
