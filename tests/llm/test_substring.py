import random
import re
from hashlib import sha256

from helpers import collected, documents
from pyspark.sql import functions as F

from quadrille.llm import substring

COLUMNS = ("doc_id", "n_words", "n_removed", "kept")


def brute(rows, size=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k:k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(df, **options):
    counted = substring.repeats(df, **options).withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]))
    return collected(counted, *COLUMNS)


def sample():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "A", "a"]
    passage = [[draw.choice(words) for _ in range(n)] for n in (12, 13, 14, 27, 60, 200)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(draw.randint(1, 5)):
            text += [draw.choice(words) for _ in range(draw.randint(0, 20))]
            p = draw.choice(passage)
            a = draw.randint(0, len(p) // 2)
            text += p[a:draw.randint(a, len(p))] if draw.random() < 0.5 else p
        rows.append((i * 3 % 80, draw.choice([" ", "\n", " \t "]).join(text)))
    few = " ".join(draw.choice("ab") for _ in range(400))  # every window overlaps others
    rows += [(200, few), (201, few[100:]), (202, "x " * 50), (203, "x " * 13), (204, "x " * 12)]
    rows += [(None, rows[0][1]), (300, None), (301, ""), (302, " \n "), (303, rows[1][1]), (303, rows[1][1]), (1, rows[2][1]), (-5, rows[3][1])]
    return rows + [(400, "y" * 100_000 + " " + rows[0][1]), (401, " ".join(w for _, t in rows[:80] for w in t.split()) + " end")]


def test_against_brute_force(spark):
    rows = sample()
    df = documents(spark, rows, n_words="x", kept="y", run="z")
    expected = brute(rows)
    assert sum(r[2] > 0 for r in expected) > 40
    assert found(df) == expected
    assert found(df.repartition(6), run_bytes=3000, share_bytes=5000) == expected


def test_other_sizes(spark):
    rows = sample()[:60]
    for size in (1, 2, 6, 7, 30):
        assert found(documents(spark, rows), size=size, run_bytes=4000) == brute(rows, size)


def test_spans_are_where_words_went(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c y d e f z")]
    result = {r["doc_id"]: r for r in substring.repeats(documents(spark, rows), size=3).collect()}
    assert [tuple(s) for s in result[2]["spans"]] == [(1, 3), (5, 3)] and result[2]["kept"] == "x y z"
    assert result[1]["spans"] == []


def test_empty_table(spark):
    assert substring.repeats(documents(spark, [])).count() == 0


def test_one_passage_in_all_documents_is_asked_for_once_a_run(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"u{i} {passage} v{i}") for i in range(3000)]
    got = {r[0]: r for r in found(documents(spark, rows), run_bytes=20_000)}
    assert got[0][2] == 0 and all(got[i][2:] == (40, f"u{i} v{i}") for i in range(1, 3000))


def test_query_digests(spark, sf):
    row = substring.op13_substring(spark, sf).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == sha256(" ".join(text.split()).encode()).hexdigest()
