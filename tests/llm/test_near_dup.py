"""Near-duplicate components against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from cohortloom.llm import near_dup as nd


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def brute(docs, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, u in sets[i + 1:]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def vocabulary(n, rng):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def edited(base, share, rng, bag):
    return [rng.choice(bag) if rng.random() < share else w for w in base]


def corpus(seed):
    """Random texts that share a common line, with copies at all distances and a star of many copies."""
    rng = random.Random(seed)
    bag, line = vocabulary(300, rng), vocabulary(12, rng)
    texts = []
    for _ in range(60):
        base = rng.choices(bag, k=rng.randrange(5, 160))
        texts.append(base + line if rng.random() < 0.5 else base)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            texts.append(edited(base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]), rng, bag))
    hub = rng.choices(bag, k=400)
    for _ in range(120):  # each within 0.8 of the hub, hardly of each other
        copy = list(hub)
        for at in rng.sample(range(0, 396, 4), 9):
            copy[at] = "zz" + rng.choice(bag)
        texts.append(copy)
    texts.append(hub)
    rng.shuffle(texts)
    return [(i * 7 % 1009, " ".join(t).title() if i % 3 else "\n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_components(spark, seed, k):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_components(df, k).collect())) == brute(docs, k, 80)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "one two", 4), (5, "ONE\ttwo", 5), (6, "one two three", 6),
            (7, "x " * 30_000, 7), (8, "x " * 30_000 + "y", 8), (9, "é" * 100_000, 9), (9, "é" * 100_000, 9), (None, "one two", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_components(df, 4).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True),
                   (8, 8, True), (9, 9, True), (None, 4, False)}
    out = nd.deduplicate(df, 4)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 4, 6, 7, 8, 9]  # the copy without id goes as well
    assert nd.near_components(df.limit(0), 4).count() == 0


def test_copies_without_id_and_clashing_names(spark):
    rows = [(None, "one two three", 1, 1), (None, "ONE two three", 2, 2), (7, "other text", 3, 3), (7, "unlike it", 4, 4),
            (9, "four five", 5, 5), (None, "four five", 6, 6), (8, "four five", 7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, __row int")
    out = nd.deduplicate(df, 4)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"].lower()) for r in out.collect())
    assert got == [("7", "other text"), ("7", "unlike it"), ("8", "four five"), ("None", "one two three")]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, j) for j in range(1001, 1400)] + [(5000, 5001)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in nd.components(df).collect()}
    for node, root in got.items():
        assert root == (0 if node <= 300 else 1000 if node < 2000 else 5000)
    assert len(got) + 3 == len({x for p in links for x in p})


def test_class_digest_ignores_order_of_shingles():
    import pyarrow as pa

    value, owner, rows = nd.row_sets(pa.array(["a b c d e a b c d e", "a b c d e a b c d e a b c d", None]), 4)
    assert rows == 3 and np.bincount(owner, minlength=3).tolist() == [5, 5, 0]


def forest(sign):
    """All candidate pairs of signatures, tree by tree as in the query."""
    keys = nd.tree_keys(sign)
    sketch = np.packbits((sign & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64)
    found = set()
    for t in range(nd.TREES):
        part = np.ascontiguousarray(keys[:, t * nd.DEPTH:(t + 1) * nd.DEPTH])
        order = np.array(sorted(range(len(part)), key=lambda i: part[i].tobytes()))
        key = np.concatenate([np.full((len(part), 1), t), part[order]], 1).astype(np.int64)
        found |= set(map(tuple, nd.tree_pairs(key, order, sketch[order], 0).tolist()))
    return found


def test_pairs_of_very_long_texts():
    rng = np.random.default_rng(5)
    n, minima = 250, nd.TREES * nd.DEPTH
    draw = lambda: rng.exponential(2**32 / 1_000_000, (n, minima)).astype(np.uint32)  # noqa: E731, minima of 1,000,000 shingles
    left = draw()
    right = np.where(rng.random((n, minima)) < 0.8, left, draw())
    found = forest(np.concatenate([left, right]))
    assert all((i, i + n) in found for i in range(n))


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(60, 20).tolist()) | (set(range(1000, 1030)) if i % 3 else set()) for i in range(40)]
    owner = np.repeat(np.arange(40), [len(x) for x in sets])
    value = np.concatenate([sorted(x) for x in sets]).astype(np.uint64)
    assert nd.shared_counts(value, owner, 40).tolist() == [[len(a & b) for b in sets] for a in sets]


def test_every_pair_of_a_crowd_meets():
    """A family larger than the reach: what the neighbours leave out is in a common crowded run."""
    rng = np.random.default_rng(6)
    n, minima = 1500, nd.TREES * nd.DEPTH
    line = rng.integers(0, 2**32, minima, dtype=np.uint64).astype(np.uint32)
    draw = lambda: rng.integers(0, 2**32, (n, minima), dtype=np.uint64).astype(np.uint32)
    left = np.where(rng.random((n, minima)) < 0.997, line, draw())
    right = np.where(rng.random((n, minima)) < 0.997, left, draw())
    sign = np.concatenate([left, right])
    found, runs = forest(sign), [set() for _ in range(2 * n)]
    keys = nd.tree_keys(sign).astype(np.int64)
    for t in range(nd.TREES):
        part = keys[:, t * nd.DEPTH:(t + 1) * nd.DEPTH]
        order = np.lexsort(part.T[::-1])
        rows, name = nd.crowd_rows(np.concatenate([np.full((2 * n, 1), t), part[order]], 1))
        for r, run in zip(order[rows].tolist(), name.tolist(), strict=True):
            runs[r].add(run)
    left_out = [i for i in range(n) if (i, i + n) not in found]
    assert left_out  # the reach alone does not do
    assert all(runs[i] & runs[i + n] for i in left_out)
    assert all(run < 0 for r in runs for run in r)


def test_crowds_are_compared_in_full(spark):
    """Texts that share most of their words with all others, and 0.8 with one partner only, in several blocks."""
    rng = random.Random(8)
    line = vocabulary(410, rng)
    docs = []
    for i in range(350):
        pair = vocabulary(28, rng)
        docs += [(2 * i + j, " ".join(line + pair + vocabulary(50, rng))) for j in (0, 1)]
    sets = [shingle_set(t, 4) for _, t in docs]
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    classes = nd.profiles(df, 4, "doc_id", "text").withColumnRenamed("doc_id", "node")
    crowd = spark.createDataFrame([(d, -1) for d, _ in docs], "node long, run long")
    roots = spark.createDataFrame([(1, 0)], "node long, root long")  # a pair that is linked already
    got = nd.crowd_links(crowd, classes, roots, df, "text", 4, 80).collect()
    want = {(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if near(a, b)} - {(0, 1)}
    assert len(docs) > nd.BLOCK and len(want) == 349
    assert {(min(r), max(r)) for r in map(tuple, got)} == want
    done = spark.createDataFrame([(d, 0) for d, _ in docs if d], "node long, root long")
    assert nd.crowd_links(crowd, classes, done, df, "text", 4, 80) is None


def test_rows_are_judged_one_by_one(spark):
    """Unrelated texts of one id stay; a copy goes whichever id it shares; of copies without id one stays, or none
    where a near copy has an id."""
    a, b, c, d, e = (" ".join(vocabulary(30, random.Random(i))) for i in range(5))
    rows = [(1, a, "stays"), (5, b, "stays"), (5, c, "stays"),
            (7, a, "copy"), (7, d, "stays"), (None, "no id " + a, "copy"), *[(None, e, "null")] * 3]
    out = nd.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, note string"), 4)
    assert out.columns == ["doc_id", "text", "note"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*(r for r in rows if r[2] == "stays"), rows[-1]]))


def test_a_crowd_is_not_paired_twice():
    """Classes of one crowded run are compared there, so the second search makes no pairs of them, while the first one ties them."""
    n = 60
    key = np.concatenate([np.ones((n, 1 + nd.CROWD_DEPTH)), np.arange(3 * n).reshape(n, 3)], 1).astype(np.uint32)
    sketch = np.zeros((n, 4), np.uint64)
    assert len(nd.crowd_rows(key)[0]) == n
    assert len(nd.tree_pairs(key, np.arange(n), sketch, 0)) == 0
    assert len(nd.tree_pairs(key, np.arange(n), sketch, 0, first=True)) >= n - 1
