"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is tokenised (its ids, then one end id) and cut into full windows and a remainder, the remainder into pieces
of at most ``PIECE`` ids.  Pieces of neighbouring rows form groups of about ``GROUP_WINDOWS`` windows of tokens.  Within
a group every piece starts as a partition of itself and empty windows; the two partitions with the largest imbalance (fullest minus emptiest window)
are merged again and again, the fullest windows of one with the emptiest of the other, until one partition is left.
If its fullest window exceeds the capacity, the group is partitioned anew with one window more.  The windows come out
near-equal, so little is padded: the padding of a group is what its windows' count exceeds its tokens by.

Groups never cross a task, so nothing is shuffled or collected, and a lost task is recomputed alone.  Sequence ids hold
the partition's number in their upper bits; they are unique, not dense.

A null text counts as empty and yields the end id alone.  Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from struct import Struct
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import query, table, tokenizer_path
from quadrille.llm.text import CHUNK, LOWER_AZ, SPACED, _cut

WINDOW, END_ID = 4096, 2
GROUP_WINDOWS, PIECE = 256, 1024
#: Words whose ids a worker keeps (about 250 bytes each); beyond it the cache starts anew.
CACHE_WORDS, CACHE_ENDINGS = 1_200_000, 10_000
#: ASCII punctuation but for the apostrophe, which may begin a word's ending ('s and the like).
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: A mark that ends a word.  It begins with the mark, so that the search skips from one to the next.
_ENDING = re.compile(rb"[.,](?=[ \n])(?<=[a-z].)")
#: The letter that stands for a byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Packers of so many little-endian unsigned 32-bit numbers.
_UNSIGNED = [Struct(f"<{n}I").pack for n in range(33)]
_tokenizers: dict[str, "WordTokenizer"] = {}


class _Known(dict):
    """Ids of words; an unknown word gets a hole, one for all its places, to be filled when it is known."""

    def __init__(self):
        super().__init__()
        self.holes: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        return self.holes.setdefault(word, bytearray())


class WordTokenizer:
    """Ids of texts under a vocabulary that never joins anything across ASCII white space.

    Such a tokenizer gives a text the ids of its words, one after another; words seen before are looked up.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()
        self.endings: dict[bytes, bytes] = {}
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content.startswith("<|")]
        described = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.byte_level = "\\p{L}]+" in json.dumps(described).replace("\\\\", "\\") and "ByteLevel" in json.dumps(described)
        self.model = self.tokenizer.model
        self.marker = special[0] if special else None

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers.

        Two rewritings that leave the ids as they are let more words be known already: capitals A-Z (the vocabulary is
        lower case) and a full stop or comma that ends a word, set apart (it is a word of its own in any case).  Text
        that may hold a special token is left alone.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for k, text in enumerate(texts):
            if self.marker is not None and b"<|" not in text:
                text = _ENDING.sub(rb" \g<0>", text.translate(LOWER_AZ))
            for _, piece in _cut(text, SPACED):
                waiting.append((k, piece.split()))
                size += len(piece)
                if size > CHUNK:
                    self._look_up(waiting, out)
                    waiting, size = [], 0
        self._look_up(waiting, out)
        return [b"".join(parts) for parts in out]

    def _look_up(self, waiting: list[tuple[int, list[bytes]]], out: list[list[bytes]]) -> None:
        """Looks up about CHUNK bytes of words, once each; what is new among them leaves holes, filled when it is learned in one go."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        holes = self.known.holes
        holes.clear()
        found = [list(map(self.known.__getitem__, piece)) for _, piece in waiting]
        self._learn(list(holes))
        for word, hole in holes.items():
            hole += self.known[word]
        for (k, _), ids in zip(waiting, found):
            out[k].append(b"".join(ids))

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a run of lower-case Latin letters, None for anything else."""
        if word.isalpha() and word.islower():  # ASCII letters stand for themselves
            if word in self.known:
                return self.known[word]
            letters = word.decode()
        else:
            text = word.decode("utf-8", "replace")
            if not (text.isalpha() and text == text.lower() and max(text) < "\u0250" and is_normalized("NFC", text)):
                return None
            letters = word.decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return _UNSIGNED[len(ids)](*ids) if len(ids) < len(_UNSIGNED) else np.array(ids, "<u4").tobytes()

    def _ending(self, marks: bytes) -> bytes:
        """Ids of a run of ASCII punctuation; after letters it is a word of its own."""
        if marks not in self.endings:
            if len(self.endings) > CACHE_ENDINGS:
                self.endings.clear()
            self.endings[marks] = np.array(self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return self.endings[marks]

    def _learn(self, words: list[bytes]) -> None:
        """Looks words up: runs of lower-case Latin letters straight in the vocabulary, as they are one symbol of its
        alphabet a byte, and punctuation after them apart; others in one call, a marker between them; words that hold a marker's characters one by one."""
        rest = []
        for word in words if self.byte_level else ():
            ids = self._letters(word)
            if ids is None:
                stem = word.rstrip(_PUNCTUATION)
                if stem != word and b"<|" not in word and (ids := self._letters(stem)) is not None:
                    ids += self._ending(word[len(stem):])
            if ids is None:
                rest.append(word)
            else:
                self.known[word] = ids
        words = rest if self.byte_level else words
        plain = [w for w in words if b"<|" not in w]
        if plain and self.marker is not None:
            joined = self.marker[0].join([w.decode("utf-8", "replace") for w in plain])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            edges = np.concatenate([[-1], np.flatnonzero(ids == self.marker[1]), [len(ids)]]).tolist()
            data = ids.tobytes()
            for word, a, b in zip(plain, edges, edges[1:]):
                self.known[word] = data[4 * (a + 1):4 * b]
            words = [w for w in words if b"<|" in w]
        for word in words:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            self.known[word] = np.array(ids, "<u4").tobytes()


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items of each window under Karmarkar-Karp differencing into ``windows`` windows.

    A partition is the ascending sums of its windows with a node per window; a node is an item or a pair of nodes.
    """
    n = len(sizes)
    left, right = np.full(2 * n + 1, -1), np.full(2 * n + 1, -1)
    made = n
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[-1], nodes[-1] = size, i
        parts[i] = (sums, nodes)
        heap.append((-size, i))
    heapq.heapify(heap)
    tag = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        (sums_a, nodes_a), (sums_b, nodes_b) = parts.pop(a), parts.pop(b)
        sums, other = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.where(nodes_a >= 0, nodes_a, other)
        both = np.flatnonzero((nodes_a >= 0) & (other >= 0))
        fresh = np.arange(made, made + len(both))
        left[fresh], right[fresh], nodes[both] = nodes_a[both], other[both], fresh
        made += len(both)
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[tag] = (sums, nodes)
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tag))
        tag += 1
    out = []
    for node in parts[heap[0][1]][1].tolist():
        items, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [int(right[x]), int(left[x])]
        out.append(sorted(items))
    return [w for w in out if w]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity; the count rises from the least possible one until they fit."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, count)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        count += 1


SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length")] + [T.StructField("ids", T.BinaryType())] +
                      [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")])


def pack(df: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", window: int = WINDOW,
         end_id: int = END_ID, group_windows: int = GROUP_WINDOWS, piece: int = PIECE) -> DataFrame:
    """One row per piece: the columns of ``df`` but ``text``, then start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset.  Columns of ``df`` with these names are replaced."""
    made = {f.name for f in SCHEMA}
    carried = [c for c in df.columns if c != text and c.lower() not in made]
    schema = T.StructType([df.schema[c] for c in carried] + SCHEMA.fields)
    n, end = len(carried), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        words = _tokenizers[path]
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            rows = [batch.column(i) for i in range(n)]
            full, waiting, tokens = [], [], 0
            for k, ids in enumerate(tokenised(words, batch.column(n))):
                ids += end
                total = len(ids) // 4
                cut = total - total % window
                for start in range(0, cut, window):
                    full.append((k, start, window, ids[4 * start:4 * (start + window)], total, sequence, 0))
                    sequence += 1
                for start in range(cut, total, piece):
                    waiting.append((k, start, min(piece, total - start), ids[4 * start:4 * (start + piece)], total))
                tokens += total - cut
                if tokens >= group_windows * window or len(full) >= group_windows:
                    if tokens >= group_windows * window:
                        placed, sequence = place(waiting, window, sequence)
                        full += placed
                        waiting, tokens = [], 0
                    yield emit(rows, full)
                    full = []
            if waiting:
                placed, sequence = place(waiting, window, sequence)
                full += placed
            if full:
                yield emit(rows, full)

    def tokenised(words, column):
        """Ids of a column's texts, about a megabyte of text at a time."""
        part, size = [], 0
        for value in column:
            part.append(value.as_py() or b"")
            size += len(part[-1])
            if size > 2 * CHUNK:
                yield from words.ids(part)
                part, size = [], 0
        yield from words.ids(part)

    def emit(rows, pieces):
        at = pa.array([p[0] for p in pieces], pa.int64())
        made = [pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.binary())]
        made += [pa.array([p[i] for p in pieces], pa.int64()) for i in (4, 5, 6)]
        return pa.RecordBatch.from_arrays([r.take(at) for r in rows] + made, names=schema.names)

    def place(waiting, window, sequence):
        pieces = []
        for items in windows_of([w[2] for w in waiting], window):
            offset = 0
            for i in items:
                pieces.append((*waiting[i], sequence, offset))
                offset += waiting[i][2]
            sequence += 1
        return pieces, sequence

    return df.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("binary")).mapInArrow(run, schema)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
