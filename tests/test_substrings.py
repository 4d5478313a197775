"""Texts that hold a key against Python's own search."""

import random
import time

import pytest

from cohortloom.operators import joins, substrings


def pieces(rng, n):
    return "".join(rng.choice("abé\U0001f600 ") for _ in range(n))


@pytest.mark.parametrize("block_bytes", [None, 60])
def test_rows(spark, block_bytes):
    rng = random.Random(1)
    texts = [None, "", "a"] + [pieces(rng, rng.randrange(40)) for _ in range(300)]
    keys = [None] + [pieces(rng, rng.randrange(1, 12)) for _ in range(40)]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id long, text string").repartition(3)
    b = spark.createDataFrame([(k,) for k in keys], "k string")
    got = sorted(r["id"] for r in substrings.containing(a, "text", b, "k", block_bytes).collect())
    want = [i for i, t in enumerate(texts * 2) if t is not None and any(k in t for k in keys if k is not None)]
    assert got == want and 0 < len(want) < len(texts) * 2


def test_edges(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "abcabd")], "id long, text string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(joins.match_substring(a, keys(""), "text", "k", exact=False)) == [1, 2, 4]
    assert ids(joins.match_substring(a, keys("abd", "zz"), "text", "k", exact=False)) == [4]
    assert ids(joins.match_substring(a, keys("abcabde", None), "text", "k", exact=False)) == []
    assert ids(joins.match_substring(a, keys(None), "text", "k", exact=False)) == []
    assert ids(joins.match_substring(a.limit(0), keys("a"), "text", "k", exact=False)) == []
    assert ids(joins.match_substring(a, keys("x", ""), "text", "k")) == [1, 2]


def test_long_texts_take_linear_time():
    keys = substrings.Keys(["needle" * 3, "a" * 40 + "b", "q"])
    start = time.time()
    texts = ["a" * 1_000_000, "é" * 999_990 + "needle" * 3, "xyz" * 300_000]
    assert keys.hits(texts).tolist() == [False, True, False]
    assert time.time() - start < 20
