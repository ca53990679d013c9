"""Contamination against a search for every window, and the query against its SQL twin."""

import hashlib
import random
import re

import duckdb
import pytest

from helpers import documents
from quadrille.llm import decontaminate as D
from quadrille.llm.common import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        size = min(13, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[k:k + size]:
                    hit.update(range(at, at + size))
                    if item is not None:
                        found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def cases():
    rng = random.Random(3)
    vocabulary = ["Ab", "cd", "é1", "x", "Yz", "日本", "q-r"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 13, 14, 30]))) for k in range(9)] + [(9, None), (10, ""), (11, "--"), (None, "lone item"), (3, text(15))]
    rows = [(k, text(rng.choice([0, 3, 40, 90]))) for k in range(30)]
    rows += [(50, items[3][1] + " tail"), (51, None), (52, ""), (50, items[3][1] + " tail"), (53, text(3000)), (54, "LONE, item!")]
    return rows, items


@pytest.mark.parametrize("block_words", [1 << 20, 20])
def test_against_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)  # the second run scans block by block
    rows, items = cases()
    docs = documents(spark, rows, n_words="clash", Hit_Spans="clash")
    benchmark = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = D.contamination(D.scan(docs, benchmark)).select("doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert len(got) == len(rows)
    for doc_id, text, *result in got:
        assert tuple(result) == brute(text, items), doc_id


def test_kept_rows_and_empty_tables(spark):
    rows, items = cases()
    docs = documents(spark, rows, n_hit="clash")
    benchmark = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    kept = D.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if not brute(t, items)[4])
    assert D.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert D.decontaminate(docs.limit(0), benchmark).count() == 0


def test_query(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES["op6_decontaminate"](spark, sf)
    want = con.execute(ORACLES["op6_decontaminate"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
