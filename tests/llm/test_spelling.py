import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import LOWER, collected, documents

from quadrille.llm import spelling


def brute(rows, changed=97, length=5, least=3):
    total = Counter()
    for doc, text in rows:
        for run, n in Counter(re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER))).items():
            if doc is not None:
                at = zlib.crc32(f"{doc}:{run}".encode())
                if at % changed == 0:
                    run = run[:at % len(run)] + run[at % len(run) + 1:]
            total[run] += n
    words = {w: n for w, n in total.items() if len(w) >= length and n >= least}

    def is_near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(near)]
    rows = []
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, words[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def sample():
    draw = random.Random(3)
    base = ["schöner", "abcde", "abcdé", "aabbcc", "aaaaa", "aaaaaa", "÷×÷×÷", "Ünder", "zebras", "q" * 300, "q" * 301]
    words = base + ["".join(draw.choice("abé") for _ in range(draw.randint(4, 7))) for _ in range(120)]
    rows = []
    for i in range(60):
        text = [draw.choice(words[:30] if draw.random() < 0.7 else words) for _ in range(40)]
        text = [w[:k] + w[k + 1:] if draw.random() < 0.15 else w for w in text for k in [draw.randrange(len(w))]]
        rows.append((i, draw.choice([" ", "1", "-", "\n", "Ā", "ё"]).join(t.upper() if draw.random() < 0.1 else t for t in text)))
    return rows + [(None, "abcde abcde abcde"), (7, None), (8, ""), (9, "123 !!"), (9, "zebras zebra zebra zebra"), (9, "zebras zebra zebra zebra")]


def test_against_brute_force_with_one_round_and_with_many(spark):
    rows = sample()
    df = documents(spark, rows, word="x", n="1", form="y")
    expected = brute(rows)
    assert len({r[2] for r in expected}) < len(expected)
    assert collected(spelling.spelling(df), *COLUMNS) == expected
    assert collected(spelling.spelling(df.repartition(7), round_words=25, part_words=10), *COLUMNS) == expected


def test_changed_runs(spark):
    rows = sample()[:20]
    assert collected(spelling.spelling(documents(spark, rows), changed=3), *COLUMNS) == brute(rows, changed=3)


def test_nothing(spark):
    assert spelling.spelling(documents(spark, [])).count() == 0
    assert spelling.spelling(documents(spark, [(1, None), (2, "")])).count() == 0
    assert collected(spelling.spelling(documents(spark, [(1, "lonely lonely lonely")])), *COLUMNS) == [("lonely", None, "lonely", 3, 0, None)]


def test_long_chain_of_forms(spark):
    words = [("a" * 5 + "b" * k, 3 * 2 ** k) for k in range(9)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words)]
    found = {r[0]: r[2] for r in collected(spelling.spelling(documents(spark, rows), changed=0), *COLUMNS)}
    assert set(found.values()) == {words[-1][0]}


def test_filter_has_no_false_negatives_and_few_false_positives():
    draw = np.random.RandomState(1)
    keys = spelling.mix(draw.randint(0, 1 << 62, 50_000).astype(np.uint64))
    bits = spelling.filter_of(keys, spelling.blocks_for(len(keys)))
    assert len(spelling.probe(bits, keys)) == len(keys)
    others = spelling.mix(draw.randint(0, 1 << 62, 200_000).astype(np.uint64))
    assert len(spelling.probe(bits, others)) < 0.01 * len(others)


def test_edits_hash_like_the_words_they_make():
    words = ["aabbç", "ÿzzzz"]
    letters = spelling.letters_of(words, 5)
    word, at, h = spelling.deleted(letters)
    made = [words[w][:i] + words[w][i + 1:] for w, i in zip(word, at)]
    assert len(set(zip(word.tolist(), made))) == len(made) == 3 + 2
    assert (h == spelling.hashes_of(spelling.letters_of(made, 4))).all()
    alphabet = np.frombuffer("abzÿ".encode("latin-1"), np.uint8)
    word, letter, h = spelling.exchanged(letters, spelling.hashes_of(letters), alphabet, 1)
    made = [words[w][:1] + chr(c) + words[w][2:] for w, c in zip(word, letter)]
    assert made == ["abbbç", "azbbç", "aÿbbç", "ÿÿzzz"]
    assert (h == spelling.hashes_of(spelling.letters_of(made, 5))).all()
