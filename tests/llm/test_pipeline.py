"""The pipeline's stages, each on the other's output: columns, decisions, and an exact round trip of the ids."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from helpers import documents
from quadrille.llm.common import tokenizer_path
from quadrille.plans.staging import stage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, kept = docs.columns, docs.count(), {}
    for name, function in C.STAGES:
        docs = stage(function(spark, docs, sf), "stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert kept["secret scans"].count() == kept["decontamination"].count()
    texts = {r["doc_id"]: r["text"] for r in kept["secret scans"].collect()}
    assert not any("token = \"" in (t or "") and "[secret]" not in t for t in texts.values())
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = kept["packing"].collect()
    assert {p["doc_id"] for p in pieces} == set(texts)
    for p in pieces[:200]:
        ids = tokenizer.encode(texts[p["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"]:p["start"] + p["length"]], "<u4").tobytes())


def test_extra_columns_nulls_and_empty(spark, sf):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "token = 'abcdefghijk'")]
    docs = documents(spark, rows, score="clash", lang="en", n_words="7", body="b", gone="g")
    for name, function in C.STAGES[:-1]:
        docs = function(spark, docs, sf)
    assert docs.columns == ["doc_id", "text", "score", "lang", "n_words", "body", "gone"]
    got = {r["doc_id"]: (r["text"], r["body"], r["gone"]) for r in docs.collect()}
    assert got == {1: (rows[0][1], "b", "g"), 3: (None, "b", "g"), 4: ("", "b", "g"), 5: ("[secret]'", "b", "g")}
    assert C.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
