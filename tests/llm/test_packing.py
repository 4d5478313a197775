"""Packing against brute force: every token once, in order, and cuts no dearer than any others."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOK = Tokenizer.from_file(PATH)


def expected_ids(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, pieces, window):
    """docs: list of (doc_id, text), unique ids; pieces: rows."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = expected_ids(text), 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            part = np.array(ids[at:at + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
            at += p["length"]
        assert at == len(ids)
    sizes = {}
    for s, group in itertools.groupby(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])),
                                      key=lambda p: p["sequence_id"]):
        at = 0
        for p in group:
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        sizes[s] = at
    return sizes


def padding(sizes, window):
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes.values())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    pieces = packing.pack(df, PATH).collect()
    sizes = check(docs, pieces, 2048)
    assert padding(sizes, 2048) < 0.02 * sum(sizes.values())


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "  \n "), (4, "word " * 6000), (5, "One. Two!\nThree? 'tis it's <|endoftext|> x<|startoftext|>y"),
            (6, "É é H̱ ﬁ … “quoted,” a.b c-d 1,234.5 don't DON'T"), (7, "x" * 5000), (8, "!" * 3000)]
    df = spark.createDataFrame([(d, t, 9, "w") for d, t in docs], "doc_id long, text string, length int, ids_crc32 string")
    pieces = packing.pack(df.repartition(3), PATH, with_ids=True).collect()
    check(docs, pieces, 2048)
    assert all(len(p["ids"]) == p["length"] for p in pieces)
    empty = packing.pack(df.limit(0), PATH)
    assert empty.count() == 0
    twice = packing.pack(df.union(df), PATH).collect()
    assert sum(p["length"] for p in twice) == 2 * sum(len(expected_ids(t)) for _, t in docs)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_cheapest(seed):
    rng = np.random.default_rng(seed)
    n, window = int(rng.integers(1, 60)), int(rng.integers(3, 12))
    docs = np.flatnonzero(rng.random(n) < 0.15) + 1
    breaks = rng.choice([0, 0, 0, packing.CLAUSE, packing.SENTENCE], n).astype(np.int8)
    at, kind = packing.boundaries(n, docs, breaks, window)
    price = packing.PENALTY
    cost = {0: 0}
    for j in range(1, len(at)):
        cost[j] = min(cost[i] + window - (at[j] - at[i]) + price[kind[j]] for i in range(j) if at[j] - at[i] <= window)
    cuts = packing.best_cuts(at, kind, window)
    got = sum(window - (at[b] - at[a]) + price[kind[b]] for a, b in zip(cuts, cuts[1:]))
    assert got == cost[len(at) - 1]


def test_blocks_join_without_loss(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    docs = [tuple(r) for r in df.select("doc_id", "text").collect()]
    check(docs, packing.pack(df, PATH, window=256).collect(), 256)
