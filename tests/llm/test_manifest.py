"""The manifest against trees built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """(root, path per node): siblings left and right on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            paths[j].append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        nodes = [sha(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = members, *climb([leaf(r) for r in members])
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        members, subroot, paths = trees[s]
        for r, path in zip(members, paths, strict=True):
            path = path + top
            shown = r
            if r[0] is not None and r[0] % 2 == 0 and r[4] is not None:
                shown = (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            h = leaf(shown)
            for a, b in path:
                h = sha(a, h, b)
            out.append((r[0], leaf(r), subroot, root, sha(*[a + b for a, b in path]), h, h == root))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "other", 5) for r in rows], SCHEMA).repartition(5)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    offered = F.when(F.col("doc_id") % 2 == 0, manifest.leaf_hash(*[lower if f == "text" else F.col(f) for f in FIELDS]))
    out = manifest.manifest(docs, "source", "doc_id", FIELDS, offered)
    assert out.columns == ["doc_id", *manifest.RESULTS]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_sources_of_all_sizes(spark):
    rng = random.Random(4)
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "hot": 700, "é": 256, "Z": 257, "z": 2}
    rows = [(rng.choice([None, rng.randrange(-500, 500), i]), s, rng.choice([None, "en"]), rng.choice([None, i]),
             rng.choice([None, "", "Ab Ä", "ab", f"T{i}"])) for s, n in sizes.items() for i in range(n)]
    rows += rows[:9]  # repeated rows
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_many_sources(spark):
    rows = [(i, f"s{i * 7919 % 300}", "en", 1, f"Text {i}") for i in range(310)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(4, "a", None, None, "Long " * 200_000)], [(2, None, "x", 1, "A"), (3, None, "x", 1, "B"), (2, "b", "x", 1, "B")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == (brute(rows) if rows else [])


def test_key_named_like_a_result(spark):
    with pytest.raises(ValueError, match="root"):
        manifest.manifest(spark.createDataFrame([(1, "a")], "root long, source string"), "source", "root", ["root"])
