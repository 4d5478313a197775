"""Models and tails against published values and each other."""

import numpy as np
import pandas as pd
import pytest

from cohortloom.functions import tails
from cohortloom.operators.stats.anova import anova, anova_coded, anova_oneway
from cohortloom.operators.stats.ols import ols
from cohortloom.operators.stats.tukey import tukey_hsd


def test_tails_match_tables():
    # Published upper 5 % and 1 % points of F, t and the studentised range.
    for f, d1, d2, p in [(4.10, 2, 10, 0.05), (3.10, 3, 20, 0.05), (5.85, 2, 20, 0.01), (161.4, 1, 1, 0.05)]:
        assert abs(tails.f_sf(f, d1, d2) - p) < 3e-4
    for t, df in [(2.228, 10), (2.042, 30), (12.706, 1)]:
        assert abs(tails.t_sf2(t, df) - 0.05) < 1e-4
    for q, k, df in [(3.88, 3, 10), (4.23, 5, 20), (3.40, 3, 60), (6.08, 2, 2), (3.63, 4, 1e9)]:
        assert abs(tails.tukey_cdf(q, k, df)[0] - 0.95) < 2e-3
        assert abs(tails.tukey_quantile(0.95, k, df) - q) < 0.02
    assert abs(tails.digamma(1) + 0.5772156649) < 1e-9 and abs(tails.trigamma(1) - np.pi ** 2 / 6) < 1e-9
    assert abs(tails.trigamma_inverse(tails.trigamma(3.7)) - 3.7) < 1e-8
    x = np.linspace(0.01, 0.99, 50)
    assert np.allclose(tails.beta_cdf(tails.beta_quantile(x, 2.5, 7), 2.5, 7), x, atol=1e-8)
    assert np.allclose(tails.beta_cdf(x, 1, 1), x)


def test_beta_quantile_of_narrow_and_of_many_shapes():
    # As narrow as a step of the log odds; two steps from a table left a gap of 4e-5 here.
    share = tails.beta_cdf(0.036, 4.04269571, 24.52226035)
    assert abs(tails.beta_cdf(tails.beta_quantile(share, 1658.89, 4974.89), 1658.89, 4974.89) - share) < 1e-11
    rng = np.random.default_rng(2)
    a, b, p = np.exp(rng.uniform(-3, 10, 500)), np.exp(rng.uniform(-3, 10, 500)), np.exp(-rng.uniform(0, 40, 500))
    x = tails.beta_quantile(p, a, b)
    inner = (x > 1e-290) & (x < 1 - 1e-9)
    assert inner.sum() > 400 and np.allclose(tails.beta_cdf(x, a, b)[inner], p[inner], rtol=1e-8, atol=0)
    assert tails.beta_quantile([0.0, 1.0], 2.0, 3.0).tolist() == [0.0, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    # Three groups worked by hand: means 2, 4, 9; grand mean 5; SSB = 78, SSW = 6.
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 3.0), ("b", 4.0), ("b", 5.0), ("c", 8.0), ("c", 9.0), ("c", 10.0),
            ("c", None), (None, 7.0)]
    return spark.createDataFrame(rows, "g string, y double")


def test_one_way_by_hand(data):
    table = {r["term"]: r for r in anova_oneway(data, "y", "g").collect()}
    assert (table["g"]["df"], table["Residuals"]["df"]) == (2, 6)
    assert np.isclose(table["g"]["sumsq"], 78) and np.isclose(table["Residuals"]["sumsq"], 6)
    assert np.isclose(table["g"]["statistic"], 39) and abs(table["g"]["p_value"] - tails.f_sf(39, 2, 6)) < 1e-12
    same = {r["term"]: r for r in anova(data, "y", ["g"]).collect()}
    for term in ("g", "Residuals"):
        assert np.isclose(same[term]["sumsq"], table[term]["sumsq"])


def _pieces(x_cols, y):
    rss, out, x = None, [], np.ones((len(y), 1))
    for block in [None, *x_cols]:
        if block is not None:
            x = np.hstack([x, block])
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        if rss is not None:
            out.append(rss - r @ r)
        rss = r @ r
    return out, rss


def test_sequential_sums_of_squares(spark):
    rng = np.random.default_rng(9)
    n = 200
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), n, p=[.6, .3, .1]), "x": rng.normal(1e5, 3, n)})
    pdf["y"] = 1e4 + 2 * (pdf["x"] - 1e5) + (pdf["g"] == "b") * 3 + rng.normal(0, 1, n)
    df = spark.createDataFrame(pdf)
    dummies = np.stack([(pdf["g"] == v).astype(float) for v in "bc"], axis=1)
    for terms, blocks in ((["g", "x"], [dummies, pdf[["x"]] - 1e5]), (["x", "g"], [pdf[["x"]] - 1e5, dummies])):
        want, rss = _pieces([np.asarray(b) for b in blocks], pdf["y"].to_numpy() - 1e4)
        got = anova(df, "y", terms).toPandas()
        assert np.allclose(got["sumsq"], [*want, rss], rtol=1e-6)
        assert np.isclose(got["sumsq"].sum(), ((pdf["y"] - pdf["y"].mean()) ** 2).sum())


def test_ols_with_factor(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 80), "x": rng.normal(50, 5, 80)})
    pdf["y"] = 3 + 0.5 * pdf["x"] - 2 * (pdf["g"] == "b") + rng.normal(0, 1, 80)
    got = ols(spark.createDataFrame(pdf), "y", ["x", "g"]).toPandas()
    x = np.stack([np.ones(80), pdf["x"], (pdf["g"] == "b").astype(float)], axis=1)
    beta = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    s2 = ((pdf["y"] - x @ beta) ** 2).sum() / 77
    assert got["term"].tolist() == ["(Intercept)", "x", "gb"]
    assert np.allclose(got["estimate"], beta)
    assert np.allclose(got["std_error"], np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2))


def test_tukey(spark, data):
    two = data.where("g in ('a', 'b')")
    row = tukey_hsd(two, "y", "g").first()
    f = {r["term"]: r for r in anova_oneway(two, "y", "g").collect()}["g"]
    assert row["comparison"] == "b-a" and np.isclose(row["estimate"], 2)
    assert abs(row["adj_p_value"] - f["p_value"]) < 1e-5  # two groups: the t test
    three = tukey_hsd(data, "y", "g").toPandas()
    assert sorted(three["comparison"]) == ["b-a", "c-a", "c-b"]
    width = tails.tukey_quantile(0.95, 3, 6) * np.sqrt(1.0 / 2 * (2 / 3))
    assert np.allclose(three["conf_high"] - three["estimate"], width)


def test_coded_response_and_collinear_design(spark, data):
    coded = anova_coded(data.dropna(), "g", ["y"]).toPandas()
    assert coded.loc[0, "df"] == 1 and coded["sumsq"].sum() > 0
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        anova(data.withColumn("y2", F.col("y") * 2), "y", ["g", "y2", "y"])


def test_a_wide_factor_needs_no_wide_expression(spark):
    from cohortloom.operators.stats import ols as o

    rng = np.random.default_rng(6)
    rows = [(f"g{i % 1000:04d}", float(rng.normal()), float(rng.normal() + i % 1000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    cp = o.cross_products(df, "y", ["g", "x"])
    assert len(cp.names) == 1001
    x = np.array([[1.0, *(float(r[0] == f"g{k:04d}") for k in range(1, 1000)), r[1] - cp.shifts[-2], r[2] - cp.shifts[-1]] for r in rows])
    assert np.allclose(cp.full, x.T @ x, atol=1e-6)
