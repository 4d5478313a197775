"""Region-level differences: combined and adjusted p values against matrix-form brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators.matrix import differential


def test_chi_squared_tail():
    assert np.allclose(tails.chi2_sf([0, 1.3, 4.0], 2), np.exp([0, -0.65, -2.0]))
    even = lambda x, m: sum(np.exp(-x / 2) * (x / 2) ** i / np.prod(np.arange(1, i + 1)) for i in range(m))
    for x in (0.1, 3.0, 9.0, 40.0, 300.0):
        assert np.isclose(tails.chi2_sf(x, 10), even(x, 5), rtol=1e-10)
    assert np.allclose(tails.chi2_sf([3.841458820694124, 6.6348966010212145], 1), [0.05, 0.01])
    x = tails.chi2_sf(np.array([9.9e5, 1e6, 1.01e6]), 1e6)
    assert 1 - 1e-9 < x[0] and abs(x[1] - 0.5) < 1e-3 and x[2] < 1e-9


@pytest.mark.parametrize("pieces", [None, 7])
def test_adjusted_p(spark, pieces):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(200) ** 3, 2)
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(200, None), (201, float("nan"))]
    out = differential.adjusted_p(spark.createDataFrame(rows, "i long, p double"), "p", "fdr", pieces).collect()
    assert len(out) == 202
    got = {r["i"]: r["fdr"] for r in out}
    order = np.argsort(p)
    want = np.empty(200)
    want[order] = np.minimum(np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1], 1)
    assert np.allclose([got[i] for i in range(200)], want) and got[200] is None and got[201] is None


def study(spark, seed=2):
    rng = np.random.default_rng(seed)
    sites, samples = 40, 30
    common = rng.normal(size=samples)
    values = rng.normal(size=(sites, samples)) + 10
    values[:12] += 2 * common  # sites of one region that go together
    values[20:30] += 1.5 * (np.arange(samples) < 15)
    values[39] = 7.0  # no spread
    age = rng.normal(50, 5, samples)
    rows = [(i, j, float(values[i, j]), "a" if j < 15 else "b" if j < 28 else "c", float(age[j]))
            for i in range(sites) for j in range(samples)]
    long = spark.createDataFrame(rows, "feature_id long, sample_id long, value double, grp string, age double")
    members = [(i, r) for i in range(sites) for r in {f"r{i // 10}", "all" if i < 38 else "r3"}] + [(39, "flat"), (999, "r1"), (5, "r0")]
    return values[:, :28], age[:28], long, members, spark.createDataFrame(members, "feature_id long, region_id string")


def brute(values, age, members):
    first = np.arange(28) < 15
    x = np.stack([np.ones(28), first.astype(float), age], axis=1)
    coef = np.linalg.lstsq(x, values.T, rcond=None)[0]
    res = values.T - x @ coef
    rss = (res ** 2).sum(0)
    se = np.sqrt(np.linalg.inv(x.T @ x)[1, 1] * rss / 25)
    tested = rss > 1e-9
    p = np.where(tested, tails.t_sf2(coef[1] / np.where(tested, se, 1), 25.0), np.nan)
    out = {}
    for r in {r for _, r in members}:
        own = sorted({i for i, s in members if s == r and i < 40})
        use = [i for i in own if tested[i]]
        means = values[own][:, first].mean(1), values[own][:, ~first].mean(1)
        comb = None
        if use:
            z = res[:, use] / np.sqrt(rss[use])
            f, k = ((z.T @ z) ** 2).sum(), len(use)
            comb = float(tails.chi2_sf(-2 * np.log(p[use]).sum() * k / f, 2 * k * k / f))
        out[r] = (len(own), means[0].mean(), means[1].mean(), (means[0] - means[1]).mean(), comb)
    return out


@pytest.mark.parametrize("limit", [None, 4, 1])
def test_regions(spark, limit):
    values, age, long, members, table = study(spark)
    got = {r["region_id"]: r for r in differential.diff_regions(long, table, "grp", "a", "b", ["age"], limit=limit).collect()}
    want = brute(values, age, members)
    assert got.keys() == want.keys()
    for name, (n, g1, g2, diff, comb) in want.items():
        r = got[name]
        assert r["n_sites"] == n and np.allclose([r["mean_g1"], r["mean_g2"], r["mean_diff"]], [g1, g2, diff])
        assert (r["comb_p"] is None) == (comb is None) and (comb is None or np.isclose(r["comb_p"], comb, rtol=1e-6))
    assert got["r2"]["comb_p"] < 1e-6 and got["flat"]["comb_p_adj"] is None
    order = sorted((r for r in got.values() if r["comb_p"] is not None), key=lambda r: r["comb_p"])
    assert [r["comb_p_adj"] for r in order] == sorted(r["comb_p_adj"] for r in order)
    ranks = {k: 1 + sum(abs(o["mean_diff"]) > abs(r["mean_diff"]) for o in got.values()) for k, r in got.items()}
    assert all(r["combined_rank"] >= ranks[k] for k, r in got.items())


def test_equal_and_unrelated_sites(spark):
    """Copies of one site say no more than the site itself."""
    _, _, long, _, _ = study(spark)
    one = long.where("feature_id = 25")
    copies = one.unionByName(one.withColumn("feature_id", F.lit(1000).cast("long"))).unionByName(
        one.withColumn("feature_id", F.lit(1001).cast("long")))
    single = differential.diff_regions(one, spark.createDataFrame([(25, "r")], "feature_id long, region_id string"), "grp", "a", "b")
    triple = differential.diff_regions(copies, spark.createDataFrame([(i, "r") for i in (25, 1000, 1001)], "feature_id long, region_id string"),
                                       "grp", "a", "b")
    alone = differential.diff_features(one, "grp", "a", "b").first()["p_value"]
    assert np.isclose(single.first()["comb_p"], alone) and np.isclose(triple.first()["comb_p"], alone)
    empty = spark.createDataFrame([], "feature_id long, region_id string")
    assert differential.diff_regions(one, empty, "grp", "a", "b").count() == 0
