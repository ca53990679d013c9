"""Counts against plain counting, probabilities that sum to one, and scores against a plain walk down the tree."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from helpers import documents, words
from quadrille.llm import lm as M


def corpus(seed=1):
    rng = random.Random(seed)
    common = ["der", "die", "das", "haus", "und", "weg", "the", "of"]
    rows = []
    for k in range(150):
        w = []
        while len(w) < rng.choice([0, 3, 40, 120]):
            w += rng.choice([["rot", "wie", "blut"], ["so", "wie", "eh"]]) if rng.random() < 0.3 else [rng.choice(common + [f"w{rng.randrange(400)}"])]
        rows.append((k, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "Weg\tDER\nweg"), (3, rows[3][1]), (504, "zzz " * 30_000)]


def test_against_a_plain_model(spark):
    rows = corpus()
    training = [t for i, t in rows if i < 120]
    tree, counted = M.fit(documents(spark, rows).filter("doc_id < 120").select("text"), p_min=1e-3)
    sequences = [words(t) + ["<end>"] for t in training]
    counts = Counter(w for s in sequences for w in s)
    total, kinds = sum(counts.values()), len(counts)
    assert (tree.total, tree.kinds) == (total, kinds)
    least = max(2, math.ceil(1e-3 * total))
    kept = [{g: c for g, c in Counter(tuple(s[i:i + n]) for s in sequences for i in range(len(s) - n + 1)).items() if c >= least} for n in (1, 2, 3)]
    assert [len(k) for k in kept] == [len(tree.words), len(tree.pairs), len(tree.triples)]
    assert tree.is_state_1.any() and tree.is_state_2.any()
    # words by hash, to read the tree's states
    import pyarrow as pa
    names = {}
    for w in counts:
        for _, _, _, found in M.symbols(pa.array([w if w != "<end>" else ""])):
            names[w] = int(M.find(tree.words, found[:1])[0])
    state = lambda g: (tree.is_state_1[names[g[0]]] if len(g) == 1 else
                       tree.is_state_2[int(M.find(tree.pairs, np.array([names[g[0]] * M.SHIFT + names[g[1]]]))[0])])

    def probability(context, symbol):
        context = tuple(context[-2:])
        while context and not (context in kept[len(context) - 1] and state(context)):
            context = context[1:]
        if not context:
            c = counts.get(symbol, 0)
            return (c - tree.discount) / total if c else tree.discount * kinds / total
        after = {g[-1]: c for g, c in kept[len(context)].items() if g[:-1] == context}
        share = {s: (c - M.STATE_DISCOUNT) / kept[len(context) - 1][context] for s, c in after.items()}
        if symbol in share:
            return share[symbol]
        suffix = context[1:]
        below = sum(probability(suffix, s) for s in share)
        return probability(suffix, symbol) * (1 - sum(share.values())) / (1 - below)

    found = M.score(documents(spark, rows, score="clash", Row="clash"), tree, counted).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    for i, text in [r for r in rows if r[0] != 504]:
        s = words(text) + ["<end>"]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(s), sum(w in counts for w in s))
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in s)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert got[i]["score"] == pytest.approx(sum(math.log10(probability(s[:k], w)) for k, w in enumerate(s)), rel=1e-6)
    for context in [(), ("rot",), ("rot", "wie"), ("der",)]:
        mass = sum(probability(context, w) for w in counts) + probability(context, "never seen")
        assert mass == pytest.approx(1, rel=1e-6)


def test_without_training_text(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    tree, counted = M.fit(docs.limit(0).select("text"))
    got = {r["doc_id"]: r for r in M.score(docs, tree, counted).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["score"] == 0 and got[2]["n_tokens"] == 1
    tree, counted = M.fit(docs.select("text"))
    assert M.score(docs.limit(0), tree, counted).count() == 0


def test_query(spark, sf):
    rows = M.op8_lm(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


@pytest.mark.parametrize("deepest", [None, 2])
def test_growing_against_a_plain_model(spark, deepest):
    """Every context whose divergence passes is used, however rare or long: plain counting of all sequences."""
    rng = random.Random(4)
    rows = corpus() + [(600 + k, " ".join([rng.choice("pqrs"), "a b c", "xyzt"[k % 4], "a b c d e"][::rng.choice([1, 1, -1])])) for k in range(300)]
    rows += [(1000 + k, f"u{k} a a a a {k % 2} a a a a a{k % 2}") for k in range(60)]
    learned = lambda i: i % 7 != 0
    texts = {k: words(t) + ["<end>"] for k, (i, t) in enumerate(rows)}
    sequences = [s for k, s in texts.items() if learned(rows[k][0])]
    counts = Counter(w for s in sequences for w in s)
    total, kinds = sum(counts.values()), len(counts)
    model = M.Tree(total, kinds, sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    node, passing, length = {}, {0: {()}}, 0

    def at(context, symbol):
        if not context:
            return float(10 ** model.root(np.array([counts.get(symbol, 0)]))[0])
        if context not in node:
            return at(context[1:], symbol)
        shares, rest = node[context]
        return shares[symbol] if symbol in shares else at(context[1:], symbol) * rest

    while passing[length] and (deepest is None or length < deepest):
        length += 1
        follow = {}
        for s in sequences:
            for i in range(length, len(s)):
                follow.setdefault(tuple(s[i - length:i]), Counter())[s[i]] += 1
        found = {}
        for c, f in follow.items():
            n, kept = sum(f.values()), {w: k for w, k in f.items() if k >= 2}
            if kept:
                found[c] = ({w: (k - 0.5) / n for w, k in kept.items()}, n, kept)
        passing[length] = set()
        for c, (shares, n, kept) in found.items():
            below = {w: at(c[1:], w) for w in kept}
            held, under = 1 - sum(shares.values()), 1 - sum(below.values())
            rest = max(held, 1e-12) / max(under, 1e-12)
            gain = sum(k * math.log(shares[w] / below[w]) for w, k in kept.items()) + n * max(held, 1e-12) * math.log(rest)
            node[c] = (shares, rest)
            if gain > len(kept) * math.log(total) / 2:
                passing[length].add(c)
    assert deepest or length > 3 and passing[3]
    every = set().union(*passing.values())
    deep = max(len(c) for c in every)
    docs = documents(spark, [(k, t) for k, (_, t) in enumerate(rows)], score="clash")
    ids = [k for k, (i, _) in enumerate(rows) if learned(i)]
    train = M.F.col("doc_id").isin(ids)
    got = {r["doc_id"]: r for r in M.score_by_growing(docs, train, ~train, deepest=deepest).collect()}
    assert len(got) == len(rows)
    for k, s in texts.items():
        want = 0.0
        for i, w in enumerate(s):
            context = next(c for n in range(min(i, deep), -1, -1) if (c := tuple(s[i - n:i])) in every)
            want += math.log10(at(context, w))
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(s), sum(w in counts for w in s), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in s), rel=1e-9)
        assert r["score"] == pytest.approx(want, rel=1e-5), k


def test_growing_without_training_text(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in M.score_by_growing(docs, M.F.lit(False), M.F.lit(True)).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["score"] == 0 and got[2]["n_tokens"] == 1
    assert M.score_by_growing(docs.limit(0), M.F.lit(True), M.F.lit(False)).count() == 0


@pytest.mark.parametrize("gap", [False, True])
def test_growing_by_several_words_at_once(spark, monkeypatch, gap):
    """Few exchanges for long contexts, and the scores of growing word by word; none beyond a length at which no context passes."""
    rng = random.Random(7)
    common = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    if gap:
        rows = [(k, f"{'pqrs'[k % 4]} m n {'wxyz'[k % 4]}") for k in range(400)]
    else:
        runs = lambda: " ".join(f"{'a ' * m}b{m}" for m in (next(i for i in range(1, 99) if rng.random() < 0.4) for _ in range(9)))
        rows = [(k, f"{common(9)} u{k} {runs()}") for k in range(400)]
    docs, train, written = documents(spark, rows), M.F.col("doc_id") % 5 != 0, []
    staged = M.stage
    monkeypatch.setattr(M, "stage", lambda df, label="stage", **more: written.append(label) or staged(df, label, **more))
    made = []
    for room in (0, 1 << 20):
        monkeypatch.setattr(M, "ROOM", room)
        written.clear()
        made.append(({r["doc_id"]: r.asDict() for r in M.score_by_growing(docs, train, ~train).collect()}, written.count("answers")))
    (one, many), (several, few) = made
    assert len(one) == len(several) == len(rows)
    for k, r in one.items():
        assert several[k]["score"] == pytest.approx(r["score"], rel=1e-6)
        assert {n: v for n, v in several[k].items() if n != "score"} == {n: v for n, v in r.items() if n != "score"}
    assert few == (3 if gap else 2) and many >= (3 if gap else 6)


def test_requests_are_small(spark, monkeypatch):
    """A run asks with numbers of words, packed, and its kept runs hold no hashes of words once these are numbered."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(200))) for k in range(300)]
    sizes, staged = [], M.stage

    def measured(df, label="stage", **more):
        made = staged(df, label, **more)
        if label == "runs":
            sizes.append(made.select(M.F.sum(M.F.octet_length("words"))).first()[0])
        return made

    monkeypatch.setattr(M, "stage", measured)
    train = M.F.col("doc_id") % 5 != 0
    assert M.score_by_growing(documents(spark, rows), train, ~train).count() == len(rows)
    assert sizes[0] > 1000 and max(sizes[1:], key=lambda n: n or 0) < 200
