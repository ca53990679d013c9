import zlib
from hashlib import sha256

from helpers import collected
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm import merkle
from quadrille.llm.common import remainder
from quadrille.plans.staging import scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, owner string, pos long, steps string"
ROWS = [(i, f"s{i % 3}", "en", i, f"line {i}\nmore\nend") for i in range(61)]
ROWS += [(100 + i, "lone", None, None, None) for i in range(1)] + [(200 + i, None, "dé", 3, "a\nß" * i) for i in range(8)]
ROWS += [(None, "s1", "x", 1, "no id\n"), (3, "s0", "en", 3, "same id"), (5, "s2", "en", 5, "line 5\nmore\nend"), (300, "s1", "", 0, ""), (301, "s1", "", 0, "\n" * 50_000)]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree(nodes):
    """Root and, per node, the (before, after) pairs on its way."""
    ways, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for k in range(len(run)):
                for i in under[a + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(h(*run))
            below.append(sum(under[a:a + 3], []))
        nodes, under = above, below
    return nodes[0], ways


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    done = []
    for s in names:
        rows = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        done.append((rows, *tree([leaf(r, r[4]) for r in rows])))
    root, over = tree([d[1] for d in done])
    out = []
    for (rows, subroot, ways), high in zip(done, over):
        for r, way in zip(rows, ways):
            steps = way + high
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if tampered and r[4] is not None else r[4])
            for before, after in steps:
                node = h(before, node, after)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], SCHEMA)


def check(df, height=merkle.HEIGHT):
    return collected(merkle.verified(df, remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit("")), height=height), *COLUMNS)


def test_against_brute_force_at_several_block_sizes(spark):
    df = table(spark, ROWS)
    expected = brute(ROWS)
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)
    assert check(df) == expected
    assert check(df.repartition(5), height=1) == expected  # blocks of three: four rounds of appends


def test_empty_table_and_single_row(spark):
    assert check(table(spark, ROWS).limit(0)) == []
    assert check(table(spark, ROWS[:1])) == brute(ROWS[:1])


def test_many_sources_of_one_row(spark):
    rows = [(i, f"only{i}", None, None, "t") for i in range(40)]
    assert check(table(spark, rows), height=2) == brute(rows)


def test_appender_extends_witnesses_of_open_subtrees():
    nodes = [h(str(i)) for i in range(20)]
    for n in range(1, 20):
        grown = merkle.Appender()
        for node in nodes[:n]:
            grown.append(node)
        root, levels = grown.close()
        expected, ways = tree(nodes[:n])
        assert root == expected
        assert [[(s["before"], s["after"]) for s in way] for way in grown.steps(levels).to_pylist()] == ways
    fixed = merkle.Appender()
    fixed.append(nodes[0])
    assert fixed.close(2) == (h(h(nodes[0])), 2)


def test_manifest_detects_any_changed_field(spark):
    df = table(spark, ROWS)
    with scratch(spark):
        leaves = df.select(F.col("source").alias("owner"), "doc_id", merkle.leaf(df).alias("node"), merkle.leaf(df, F.concat("text", F.lit("x"))).alias("other"))
        rows = merkle.manifest(leaves, ["doc_id", "node"])
        ok = rows.select((merkle.folded(F.col("node"), F.col("steps")) == F.col("root")).alias("ok"),
                         (merkle.folded(F.col("other"), F.col("steps")) == F.col("root")).alias("bad"), F.col("other") == F.col("node"))
        assert {tuple(r) for r in ok.collect()} <= {(True, False, False), (True, True, True)}
    assert isinstance(rows.schema["steps"].dataType, T.ArrayType)
