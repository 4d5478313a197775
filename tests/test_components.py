"""Components of matrices of any shape, their tests against sample columns, and the clusters on them."""

import numpy as np
import pytest

from cohortloom.functions import tails
from cohortloom.operators.matrix import reduce as red


def frame(spark, values, drop=lambda i, j: False):
    rows = [(j, f"s{i:05}", float(v)) for i, row in enumerate(values) for j, v in enumerate(row) if not drop(i, j)]
    return spark.createDataFrame(rows, "feature_id long, sample_id string, value double")


def dense_scores(values, k):
    centred = values - np.nanmean(values, axis=0)
    u, s, _ = np.linalg.svd(np.where(np.isnan(centred), 0.0, centred), full_matrices=False)
    out = (u * s)[:, :k]
    return out * np.sign(out[np.abs(out).argmax(0), np.arange(out.shape[1])])


def collected(df):
    return np.array([list(r)[1:] for r in sorted(df.collect())])


@pytest.mark.parametrize("shape, max_side", [((40, 7), None), ((7, 40), None), ((30, 25), 0)])
def test_scores_agree_with_a_dense_solve(spark, shape, max_side):
    rng = np.random.default_rng(3)
    values = rng.normal(size=shape) * np.geomspace(9, 0.01, shape[1]) + 50
    got = collected(red.pca(frame(spark, values), 3, max_side=max_side))
    assert np.allclose(got, dense_scores(values, 3), atol=1e-5)


def test_missing_cells_count_as_their_features_mean(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(30, 9)) * np.linspace(1, 4, 9)
    gone = rng.random(values.shape) < 0.3
    df = frame(spark, values, lambda i, j: gone[i, j])
    want = dense_scores(np.where(gone, np.nan, values), 2)
    for max_side in (None, 0):  # the block holds all nine directions, so it settles at once
        assert np.allclose(collected(red.pca(df, 2, max_side=max_side)), want, atol=1e-5)


def test_scaling_keeps_distances_of_many_samples(spark):
    """20,000 samples: nothing of samples by samples is built, on the driver or in a task."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(20_000, 5)) * [5, 4, 3, 2, 1]
    df = spark.createDataFrame([(f"s{i:05}", row.tolist()) for i, row in enumerate(values)], "sample_id string, v array<double>")
    long = df.selectExpr("sample_id", "posexplode(v) as (feature_id, value)")
    flat = collected(red.mds(long, 5))
    some = rng.integers(0, 20_000, (500, 2))
    apart = lambda x: np.sqrt(((x[some[:, 0]] - x[some[:, 1]]) ** 2).sum(1))
    assert flat.shape == (20_000, 5) and np.allclose(apart(flat), apart(values), atol=1e-8)
    sizes = red.cluster_samples(long, 3).groupBy("cluster").count().collect()
    assert len(sizes) == 3 and sum(r["count"] for r in sizes) == 20_000


def test_edges(spark):
    df = frame(spark, np.array([[1.0, 2.0], [3.0, 5.0]]))
    assert red.pca(df, 5).columns == ["sample_id", "pc1", "pc2"]
    assert red.pca(df.limit(0), 2).count() == 0
    same = frame(spark, np.ones((4, 3)))
    for max_side in (None, 0):
        assert np.allclose(collected(red.pca(same, 2, max_side=max_side)), 0)
    with pytest.raises(ValueError, match="without values"):
        red.pca(df.unionByName(spark.createDataFrame([(1, "none", None)], df.schema)), 1)


def test_association(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(size=(60, 8))
    batch, age = rng.choice(["a", "b", "c"], 60), rng.normal(50, 9, 60)
    values[:, 0] += 3 * (batch == "b")
    values[:, 1] += 0.2 * age
    scores = red.pca(frame(spark, values), 3)
    rows = [(f"s{i:05}", str(batch[i]) if i else None, float(age[i]), "one") for i in range(60)]
    pheno = spark.createDataFrame(rows, "sample_id string, batch string, age double, same string")
    got = {(r["component"], r["term"]): r for r in red.pc_association(scores, pheno, ["batch", "age", "same"]).collect()}
    assert len(got) == 9
    y = collected(scores)
    for j in range(3):
        r = got[f"pc{j + 1}", "batch"]
        groups = [y[1:, j][batch[1:] == g] for g in "abc"]
        grand = y[1:, j].mean()
        between, within = sum(len(g) * (g.mean() - grand) ** 2 for g in groups), sum(((g - g.mean()) ** 2).sum() for g in groups)
        f = between / 2 / (within / 56)
        assert r["df"] == 2 and np.isclose(r["sumsq"], between) and np.isclose(r["statistic"], f)
        assert np.isclose(r["p_value"], tails.f_sf(f, 2, 56), rtol=1e-6)
        r = got[f"pc{j + 1}", "age"]
        b = np.polyfit(age, y[:, j], 1)
        rss = ((y[:, j] - np.polyval(b, age)) ** 2).sum()
        part = ((y[:, j] - y[:, j].mean()) ** 2).sum() - rss
        assert r["df"] == 1 and np.isclose(r["sumsq"], part) and np.isclose(r["statistic"], part / (rss / 58))
        assert got[f"pc{j + 1}", "same"]["df"] == 0 and got[f"pc{j + 1}", "same"]["p_value"] is None
