"""Spans of the fixed patterns against the patterns themselves, and what the battery finds and leaves alone."""

import hashlib
import random
import re
import time

from helpers import documents
from quadrille.llm import secrets as S

PATTERNS = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
ORDER = {k: i for i, (k, *_) in enumerate(PATTERNS)}


def plain(text):
    spans = []
    for kind, pattern, group, least in PATTERNS:
        for m in re.finditer(pattern, text, re.A):
            if len(m[1] if group else m[0]) >= least:
                spans.append((m.start(), m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def texts():
    rng = random.Random(11)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = ["", "plain words, nothing here.", "password: token: abcdefghij", "PassWord = 'hunter2hunter2' and api_key=\"x\"", "é token=" + key(20, b64),
           "AKIA" + key(12, "ABCDEFGHIJ0123456789"), "AKIAAKIA" + key(9, "ABC012"), key(31, hexa), key(32, hexa) + "g" + key(40, hexa), "tokenſ=abcdefgh",
           "secret\n=abcdefghij", "a" * 5000, key(64, hexa).upper(), key(44, b64), "Donaudampfschifffahrtsgesellschaftskapitaen", "=" * 40,
           "passwd==" + key(12, b64), "x" * 40 + "1A", "0" * 40]
    pieces = ["token", "=", ":", " ", '"', "AKIA", "secret", "api_key", key(9, b64), key(40, hexa), "ZZZZ", "\n", "é"]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(300)]


def test_base_spans():
    for text in texts():
        assert S.base_spans(text) == plain(text), text


def test_operator(spark):
    every = texts()
    rows = list(enumerate(every)) + [(900, None), (5, every[5])]
    docs = documents(spark, rows, Spans="clash", n_hex="clash")
    got = S.find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()
    assert len(got) == len(rows)
    bodies = dict(rows)
    for doc_id, assign, access, hexa, digest, spans in got:
        base = plain(bodies[doc_id] or "")
        joined = [f"{k}:{a}:{b}" for a, b, k in base]
        assert [assign, access, hexa] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert digest == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(spans.split(",")) | {""} and [s for s in spans.split(",") if s and not s.startswith("random")] == joined
    assert S.find_secrets(docs.limit(0)).count() == 0


def test_battery_and_masking(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice(ALPHABET) for _ in range(44))
    ALPHABET = S.ALPHABETS[3][1]
    keys = [key() for _ in range(40)]
    dull = ["Aa1" * 15, "Abcdefghijklmnopqrstuvwxyz0123456789Abcdefg", "Zz0" + "q" * 41]
    docs = documents(spark, [(i, f"see {k} there") for i, k in enumerate(keys + dull)] + [(99, None), (98, "Straßenbahnhaltestellenverzeichnis und mehr")])
    spans = {r["doc_id"]: r["spans"] for r in S.find_secrets(docs).collect()}
    assert sum(spans[i] == "random:4:48" for i in range(40)) >= 36
    assert all(spans[40 + i] == "" for i in range(len(dull))) and spans[98] == "" and spans[99] == ""
    masked = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
    assert masked[99] is None and masked[98].endswith("mehr") and masked[0] == "see [secret] there"
    assert S.redact(docs).columns == docs.columns


def test_uniform_keys_are_rarely_judged_dull():
    rng = random.Random(1)
    for name, letters, _ in S.ALPHABETS:
        p = [S.battery("".join(rng.choice(letters) for _ in range(48)), name) for _ in range(400)]
        assert sum(x < 0.01 for x in p) <= 20, name


def test_keys_of_every_alphabet_are_found_and_masked(spark):
    rng = random.Random(8)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + lower, digits + upper, lower + "234567", upper + "234567", lower + upper]
    for letters in alphabets:
        keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (20, 32, 40, 64) for _ in range(50)]
        words = ["internationalisation2", "DonaudampfschifffahrtsGesellschaft", "aaaaaaaaaaaaaaaaaaaaaaa1", "ZZZZZZZZZZZZZZZZZZZZZZZZZZZ9"]
        docs = documents(spark, [(i, f"see {k} there") for i, k in enumerate(keys + words)])
        masked = {r["doc_id"]: r["text"] for r in S.redact(docs).collect()}
        assert sum(masked[i] == "see [secret] there" for i in range(len(keys))) >= 0.9 * len(keys), letters
        assert [masked[len(keys) + k] for k in (1, 2, 3)] == [f"see {w} there" for w in words[1:]], letters


def test_many_spans_in_one_text_take_linear_time():
    rng = random.Random(3)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    parts = [key(40, "0123456789abcdef") if k % 2 else key(30, S.ALPHABETS[3][1]) for k in range(30_000)]
    text = " ".join(parts)
    start = time.process_time()
    spans = S.all_spans(text, {})
    assert time.process_time() - start < 30
    fixed = [s for s in spans if s[2] != "random"]
    assert len(fixed) >= 15_000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
