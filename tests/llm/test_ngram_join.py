"""Components against all overlaps, with columns made frequent so that every path is taken."""

import random
from collections import Counter, defaultdict

import pytest

from helpers import documents, words
from quadrille.llm import components as C
from quadrille.llm import ngram_join as J
from quadrille.plans.staging import scratch


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def brute(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    union, holders = Union(), defaultdict(list)
    for i in sorted(sets):
        union.find(i)
        for s in sets[i]:
            holders[s].append(i)
    for i, own in sets.items():
        overlap = Counter(j for s in own for j in holders[s] if j > i)
        for j, o in overlap.items():
            if 100 * o >= 80 * (len(own) + len(sets[j]) - o):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: [word() for _ in range(n)]
    rows, base, passage = [], text(120), text(50)
    for k in range(70):  # near copies of one text, some only linked over others
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for k in range(40):  # a passage that many texts share, mostly or in part
        rows.append(text(rng.choice([2, 5, 9, 60])) + passage + text(rng.choice([0, 3, 8])))
    for k in range(60):
        rows.append(text(rng.choice([1, 2, 4, 5, 6, 40])))
    rows += [list(base)] * 6 + [[]] * 2 + [text(8000)]
    rows.append(rows[-1] + text(3))
    rows = [" ".join(w) for w in rows]
    rng.shuffle(rows)
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows)) + [(10_001, None), (10_002, " \n"), (10_003, rows[0].upper()), (10_004, rows[1].replace(" ", "\t\n"))]


@pytest.mark.parametrize("seed,hot,rows_left", [(1, 64, 512), (2, 4, 512), (3, 2, 5)])
def test_against_all_overlaps(spark, monkeypatch, seed, hot, rows_left):
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "ROWS_LEFT", rows_left)
    monkeypatch.setattr(J, "ROWS_RIGHT", 3 * rows_left)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(documents(spark, rows, tag="clash", Node="clash", n="x")).collect()}
    assert got == brute(rows)


def test_without_broadcasts_and_with_few_hot_columns(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "MAX_HOT", 20)
    monkeypatch.setattr(J, "MAX_IDS", 0)
    rows = corpus(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(spark):
    docs = documents(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "x"), (7, "x"), (7, "y")],
                     lang="en")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.components(docs).collect() if r["doc_id"] is not None)
    assert got == [(False, 2, 2, 2), (False, 4, 2, 2), (False, 4, 2, 2), (False, 7, 1, 7), (False, 7, 1, 7), (False, 7, 1, 7)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["lang"]) for r in J.keep_first(docs).collect())
    assert kept == [(0, "", "en"), (0, "a b c d e f", "en"), (2, "a b c d e f", "en"), (7, "x", "en"), (7, "y", "en")]
    assert J.components(docs.limit(0)).count() == 0 and J.keep_first(docs.limit(0)).count() == 0


def test_a_clean_text_stays_though_its_id_has_a_copy_elsewhere(spark):
    copy, clean = "a b c d e f g h", "q r s t u v w x"
    docs = documents(spark, [(3, copy), (7, copy), (7, clean), (7, clean), (7, ""), (8, copy), (9, "k l m n o p")], node="clash", gone="clash")
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, copy), (7, ""), (7, clean), (9, "k l m n o p")]


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    union = Union()
    for a, b in links:
        union.join(a, b)
    got = {r["node"]: r["root"] for r in C.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in union if union.find(x) != x}
    assert C.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_read_written_distinct_sets(spark):
    rows = corpus(5)
    with scratch(spark):
        join = J.Join(J.set_table(documents(spark, rows), "doc_id", "text", 5), 80, 100)
        assert "Join" not in join.rows._jdf.queryExecution().toString()
        assert join.rows.count() == join.nodes.count() < sum(bool(words(text)) for _, text in rows)
        assert join.sizes.count() == len(rows)


def test_sets_travel_in_small_batches(spark, monkeypatch):
    names, seen, connected = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"], [], J.connected
    before = [spark.conf.get(n) for n in names]
    monkeypatch.setattr(J, "connected", lambda links: seen.extend(spark.conf.get(n) for n in names) or connected(links))
    rows = corpus(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(documents(spark, rows)).collect()}
    assert got == brute(rows)
    assert set(map(int, seen)) == {J.BATCH_ROWS} and J.BATCH_ROWS <= 1000
    assert [spark.conf.get(n) for n in names] == before
