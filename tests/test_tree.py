"""Spanning trees, components and the sample tree against brute force."""

import random

import numpy as np
import pytest

from cohortloom.operators import graphs
from cohortloom.operators.matrix import tree


def kruskal(edges):
    parent, out = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted(edges):
        if root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            out.append((a, b, w))
    return sorted(out), {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1])
def test_forest_and_components(spark, seed):
    rng = random.Random(seed)
    edges = {(float(rng.randrange(6)), *sorted(rng.sample(range(g * 100, g * 100 + 40), 2))) for g in range(3) for _ in range(70)}
    edges |= {(1.0, i, i + 1) for i in range(1000, 1200)}  # a long chain
    best = {}
    for w, a, b in edges:
        best[a, b] = min(w, best.get((a, b), w))
    df = spark.createDataFrame([(b, a, w) if rng.random() < 0.5 else (a, b, w) for w, a, b in edges] + [(7000, 7000, 1.0)],
                               "a long, b long, w double")
    want, roots = kruskal([(w, a, b) for (a, b), w in best.items()])
    assert sorted(tuple(r) for r in graphs.spanning_forest(df).collect()) == want
    got = {r["node"]: r["root"] for r in graphs.components(df).collect()}
    smallest = {}
    for x, r in roots.items():
        smallest[r] = min(x, smallest.get(r, x))
    assert got == {**{x: smallest[r] for x, r in roots.items()}, 7000: 7000}
    assert graphs.components(df.limit(0)).count() == 0 and graphs.spanning_forest(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8])
def test_sample_tree(spark, block):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=(25, 4)), rng.normal(size=(25, 4)) + 40, rng.normal(size=(10, 4)) - 60])
    rows = [(j, f"s{i:03}", float(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    long = spark.createDataFrame(rows, "feature_id long, sample_id string, value double")
    merges = tree.sample_tree(long, block=block)
    got = sorted((r["step"], r["sample_a"], r["sample_b"], r["height"]) for r in merges.collect())
    away = np.sqrt(((values[:, None] - values[None]) ** 2).sum(2))
    want, _ = kruskal([(away[i, j], i, j) for i in range(60) for j in range(i + 1, 60)])
    assert [s for s, *_ in got] == list(range(1, 60))
    assert np.allclose([h for *_, h in got], sorted(w for *_, w in want))
    assert {(a, b) for _, a, b, _ in got} == {(f"s{a:03}", f"s{b:03}") for a, b, _ in want}
    clusters = {}
    for r in tree.cut_tree(merges, 3).collect():
        clusters.setdefault(r["cluster"], []).append(r["sample"])
    assert sorted(map(len, clusters.values())) == [10, 25, 25] and set(clusters) == {"s000", "s025", "s050"}


def test_blocks_far_apart_are_not_compared(spark):
    rng = np.random.default_rng(9)
    points = [(i, (rng.normal(size=3) + 1000 * (i % 20)).tolist()) for i in range(400)]
    df = spark.createDataFrame(points, "node long, x array<double>")
    edges = tree.candidate_edges(df, 400, block=20)
    lengths = [r["w"] for r in edges.collect()]
    assert len(lengths) < 20 * 400  # all pairs of 20 blocks would give about 200 * 39 + 400 edges
    tree_edges = graphs.spanning_forest(edges)
    assert tree_edges.count() == 399


def test_small_and_equal(spark):
    one = spark.createDataFrame([(1, "a", 2.0)], "feature_id long, sample_id string, value double")
    assert tree.sample_tree(one).count() == 0
    same = spark.createDataFrame([(1, s, 2.0) for s in "abcd"], "feature_id long, sample_id string, value double")
    assert [r["height"] for r in tree.sample_tree(same).collect()] == [0.0] * 3


def test_evenly_spread_points_and_copies_give_the_tree_alone(spark):
    """No block lies apart and many points are equal; what comes out is the tree and not an edge more."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(200, 6))
    values[150:] = values[rng.integers(0, 150, 50)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "node long, x array<double>")
    away = np.sqrt(((values[:, None] - values[None]) ** 2).sum(2))
    want, _ = kruskal([(away[i, j], i, j) for i in range(200) for j in range(i + 1, 200)])
    got = sorted((r["a"], r["b"], r["w"]) for r in tree.candidate_edges(df, 200, block=16).collect())
    assert [e[:2] for e in got] == [e[:2] for e in want] and np.allclose([e[2] for e in got], [e[2] for e in want])
