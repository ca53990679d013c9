"""Packing: an exact round trip through the ids, sequences without gaps, little padding, and the tokenizer word by word."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import documents
from quadrille.llm import packing as P
from quadrille.llm.common import tokenizer_path

ODD = ["Héllo Wörld's don't", "é x̸= y", "y\x1cz a\x0bb\x0cc\x85d", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ΑΣ ΑΣΑ Σ", "가 ᆨ", "123 ½ ²",
       "İstanbul ſ K", "'s ' s", "x\x00y", "  \n\t ", "word, word. word., WORD. 's.", "a.b, c,d", "👩‍👩‍👧 é,", "日本語 テキスト。"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_word_by_word(tokenizer):
    words = P.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    long = " ".join(ODD) * 3000
    for text, got in zip(ODD + [long], words.ids([t.encode() for t in ODD + [long]])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def test_differencing():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 513) for _ in range(900)]
    windows = P.windows_of(sizes, 4096)
    assert sorted(i for w in windows for i in w) == list(range(900))
    loads = [sum(sizes[i] for i in w) for w in windows]
    assert max(loads) <= 4096 and max(loads) - min(loads) <= 64
    assert P.windows_of([4096], 4096) == [[0]]
    assert len(P.windows_of([3000, 3000, 3000], 4096)) == 3  # two windows would be too full


def test_round_trip(spark, tokenizer):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "Ontion", "él", "x9,"]) for _ in range(rng.choice([0, 1, 30, 700, 5000])))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "z " * 20000), (7, rows[7][1])]
    pieces = P.pack(documents(spark, rows, offset="clash", IDS="clash")).collect()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    seen = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and ids == want[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["doc_tokens"] == len(want[p["doc_id"]])
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for doc_id, ids in want.items():
        parts = sorted(seen[doc_id]) if doc_id != 7 else sorted(set(seen[7]))
        assert sum(n for _, n in parts) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 4096
    assert P.pack(documents(spark, rows).limit(0)).count() == 0


def test_query(spark, sf, tokenizer):
    got = P.op5_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for row in docs[:40]:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        for p in got[got.doc_id == row["doc_id"]].itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    loads = got.groupby("sequence_id")["length"].sum()
    assert set(got.doc_id) == {r["doc_id"] for r in docs} and loads.max() <= 4096
    assert 4096 * len(loads) <= 1.02 * loads.sum() + 8 * 4096  # at most one part-filled group a task


def test_new_words_are_looked_up_once(monkeypatch):
    tokenizer = P.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    looked_up = []

    class Counted(type(tokenizer.known)):
        def get(self, word):
            looked_up.append(word)
            return super().get(word)

        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    tokenizer.known = Counted()
    monkeypatch.setattr(P, "CACHE_WORDS", 6)  # the second call starts anew
    for texts in (["zyxwv qponm, zyxwv 12,000 été zyxwv.", "", "qponm <|endoftext|> qponm's 12,000"], ["zyxwv hgfedc", "zyxwv 12,000"]):
        del looked_up[:]
        n = sum(len(t.split()) for t in texts) + 2  # a full stop and a comma are set apart
        got = tokenizer.ids([t.encode() for t in texts])
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [
            tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(looked_up) <= n + len(set(looked_up))
        assert all(type(ids) is bytes for ids in tokenizer.known.values())
