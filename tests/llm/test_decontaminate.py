"""The index against scanning, and removal spans against a word-by-word search."""

import hashlib
import re

import numpy as np
import pytest

from cohortloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        for at in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at:at + width]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[at:at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 300)))
    index = dc.FMIndex(text, sample=int(rng.integers(1, 9)))
    for n in (1, 2, 3, 7):
        patterns = rng.integers(1, 7, (30, n))
        low, high = index.find(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it"), (2, "Short item é here"), (3, None),
         (4, " ... "), (2, "Short item é here"), (5, "fox jumps over the lazy dog and runs away from it again today"), (None, "unnamed item")]
DOCS = [(1, None), (2, ""), (3, "x, the QUICK brown fox; jumps over the lazy dog and runs. y"), (4, "short ITEM é here short item É here"),
        (5, "nothing of it"), (6, "the quick brown fox jumps over the lazy dog and"), (7, "a " * 5000 + "the quick brown fox jumps over the lazy dog and runs away from it again today " * 3),
        (8, "unnamed\nitem"), (3, "x, the QUICK brown fox; jumps over the lazy dog and runs. y")]


def frames(spark):
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in DOCS], "doc_id long, text string, found string, doc int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 120])
def test_report(spark, block):
    docs, items = frames(spark)
    got = sorted(map(tuple, dc.report(docs, items, ["doc_id"], block_bytes=block).collect()), key=repr)
    assert got == brute(DOCS, ITEMS)


def test_removal(spark):
    docs, items = frames(spark)
    out = dc.remove(docs, items)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[5] == "nothing of it" and rows[1] is None and rows[2] == ""
    assert rows[3] == "x, \n. y" and 6 not in rows and 8 not in rows
    assert not any(r["contaminated"] for r in dc.report(out, items, ["doc_id"]).collect())


def test_cut_text_is_searched_again(spark):
    inner = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"keep a b c d e {inner} f g h i j keep")], "doc_id long, text string")
    items = spark.createDataFrame([(1, inner)], "item_id long, text string")
    assert " ".join(dc.remove(docs, items).first()["text"].split()) == "keep keep"


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert dc.report(docs.limit(0), items, ["doc_id"]).count() == 0
    assert dc.report(docs, items.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_planted_passages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = sorted(map(tuple, dc.report(docs, items, ["doc_id"]).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()],
                        [tuple(r) for r in items.select("item_id", "text").collect()])
