"""Matrix operators against brute force in numpy, and their stated properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators.matrix import bmiq, combat, core, covariates, differential, filters, normalise, reduce, regions
from cohortloom.sources.probes import long_to_wide, wide_to_long


def _melt(values, **sample_columns):
    g, n = values.shape
    pdf = pd.DataFrame({"feature_id": np.repeat(np.arange(g), n), "sample_id": np.tile(np.arange(n), g),
                        "value": values.ravel()})
    for name, col in sample_columns.items():
        pdf[name] = np.asarray(col)[pdf["sample_id"]]
    return pdf


def _wide(df):
    return df.toPandas().pivot(index="feature_id", columns="sample_id", values="value").to_numpy()


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    g, n = 40, 24
    batch = np.array(list("aaaaaaaabbbbbbbbcccccccc"))
    age = rng.uniform(40, 80, n)
    sex = rng.choice(["F", "M"], n)
    shift = {"a": 0.0, "b": 1.5, "c": -1.0}
    values = (rng.normal(8, 2, (g, 1)) + rng.normal(0, 1, (g, n)) * np.array([{"a": 1, "b": 2, "c": .7}[b] for b in batch])
              + np.array([shift[b] for b in batch]) + rng.normal(0.05, 0.02, (g, 1)) * (age - 60))
    values[3] = 5.0
    pdf = _melt(values, batch=batch, age=age, sex=sex)
    return spark.createDataFrame(pdf).repartition(6).cache(), values, batch, age, sex


def _combat_by_hand(dat, batch, mod):
    """Batch correction written out with matrices, for complete data."""
    levels = sorted(set(batch))
    onehot = np.stack([(batch == b).astype(float) for b in levels], axis=1)
    x = np.hstack([onehot, mod])
    n = len(batch)
    coef = np.linalg.lstsq(x, dat.T, rcond=None)[0]
    sizes = onehot.sum(axis=0)
    grand = sizes / n @ coef[:len(levels)]
    resid = dat - (x @ coef).T
    sigma = np.sqrt((resid ** 2).mean(axis=1))
    ok = sigma > 1e-8
    fitted = grand[:, None] + (mod @ coef[len(levels):]).T
    out = dat.copy()
    z = (dat[ok] - fitted[ok]) / sigma[ok, None]
    for i, b in enumerate(levels):
        cols = batch == b
        zb, nb = z[:, cols], cols.sum()
        ghat, dhat = zb.mean(axis=1), zb.var(axis=1, ddof=1)
        gbar, t2 = ghat.mean(), ghat.var(ddof=1)
        m, v = dhat.mean(), dhat.var(ddof=1)
        a, bb = (2 * v + m * m) / v, (m * v + m ** 3) / v
        g, d = ghat.copy(), dhat.copy()
        for _ in range(500):
            g = (t2 * nb * ghat + d * gbar) / (t2 * nb + d)
            d = (0.5 * ((zb - g[:, None]) ** 2).sum(axis=1) + bb) / (nb / 2 + a - 1)
        fixed = (zb - g[:, None]) / np.sqrt(d)[:, None] * sigma[ok, None] + fitted[ok][:, cols]
        rows = np.where(ok)[0]
        out[np.ix_(rows, np.where(cols)[0])] = fixed
    return out


@pytest.mark.parametrize("covs", [[], ["age"], ["age", "sex"]])
def test_combat_equals_the_matrix_form(study, covs):
    df, values, batch, age, sex = study
    mod = np.stack([{"age": age, "sex": (sex == "M").astype(float)}[c] for c in covs], axis=1) if covs else np.zeros((24, 0))
    got = _wide(combat.combat(df, "batch", covs, conv=1e-10))
    assert np.allclose(got, _combat_by_hand(values, batch, mod), atol=1e-6)
    assert np.allclose(got[3], 5.0)  # a constant feature passes through


def test_combat_lowers_batch_variance_and_ignores_row_order(study):
    df, values, batch, _, _ = study
    a = _wide(combat.combat(df))
    b = _wide(combat.combat(df.orderBy(F.rand(3)).repartition(3)))
    assert np.allclose(a, b, atol=1e-8)
    spread = lambda m: np.var([m[:, batch == x].mean(axis=1) for x in "abc"], axis=0).mean()
    assert spread(a) < 0.05 * spread(values)


def test_combat_guards(spark, study):
    df, values, _, _, _ = study
    one = df.withColumn("batch", F.lit("x"))
    assert np.allclose(_wide(combat.combat(one)), values)
    confounded = df.withColumn("dose", F.when(F.col("batch") == "a", 1.0).otherwise(0.0))
    with pytest.raises(ValueError):
        combat.combat(confounded, "batch", ["dose"])
    single = df.withColumn("batch", F.when(F.col("sample_id") == 0, "solo").otherwise(F.col("batch")))
    out = _wide(combat.combat(single))
    assert np.isfinite(out).all()
    holes = df.withColumn("value", F.when((F.col("feature_id") == 1) & (F.col("sample_id") == 2), None).otherwise(F.col("value")))
    got = _wide(combat.combat(holes, "batch", ["age"]))
    assert np.isnan(got[1, 2]) and np.isfinite(np.delete(got[1], 2)).all()


def test_residuals_are_free_of_covariates(study):
    df, values, _, age, sex = study
    got = _wide(covariates.ols_residualise(df, ["age", "sex"]))
    x = np.stack([age - age.mean(), (sex == "M") - (sex == "M").mean()], axis=1)
    assert np.allclose((got - got.mean(axis=1, keepdims=True)) @ x, 0, atol=1e-7)
    assert np.allclose(got.mean(axis=1), values.mean(axis=1))


def test_shrunken_removal_tends_to_least_squares(study):
    df, values, *_ = study
    varying = df.where("feature_id <> 3")
    exact = _wide(covariates.ols_residualise(varying, ["age", "sex"]))
    flat = _wide(covariates.eb_remove_covariates(varying, ["age", "sex"], prior_scale=1e12))
    shrunk = _wide(covariates.eb_remove_covariates(varying, ["age", "sex"]))
    assert np.allclose(flat, exact, atol=1e-5)
    raw = np.delete(values, 3, axis=0)
    assert 0 < np.abs(shrunk - exact).max() < np.abs(raw - exact).max()
    assert np.allclose(shrunk.mean(axis=1), raw.mean(axis=1))


def test_design_rows(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "c"), (None, "a")], "v double, g string")
    out, names = core.design(df, ["v", "g"])
    assert names == ["(Intercept)", "v", "gb", "gc"]
    assert [r["x"] for r in out.collect()] == [[1, 1, 1, 0], [1, 2, 0, 0], [1, 3, 0, 1], None]


def test_vst_evens_the_spread(spark):
    rng = np.random.default_rng(2)
    level = rng.uniform(100, 20000, 800)
    pdf = pd.DataFrame({"feature_id": range(800), "sample_id": "s", "value": level, "stdev": 0.1 * level + 30,
                        "detection": np.where(level < 600, 0.5, 0.0)})
    out = normalise.vst(spark.createDataFrame(pdf)).toPandas().sort_values("feature_id")
    y = out["value"].to_numpy()
    slope = np.gradient(y[np.argsort(level)], np.sort(level)) * (0.1 * np.sort(level) + 30)
    assert slope[5:-5].std() / slope[5:-5].mean() < 0.05
    assert (np.diff(y[np.argsort(level)]) > 0).all()


def test_rsn_maps_distorted_copies_back(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(8, 1.5, 600)
    values = np.stack([base + rng.normal(0, 0.05, 600), base * 1.2 - 1 + rng.normal(0, 0.05, 600),
                       base + 0.4 + rng.normal(0, 0.05, 600), base + rng.normal(0, 0.05, 600)], axis=1)
    out = _wide(normalise.rsn(spark.createDataFrame(_melt(values))))
    before = np.abs(values - base[:, None]).mean(axis=0)
    after = np.abs(out - out[:, [0]]).mean(axis=0)
    assert after[1] < 0.25 * before[1] and after[2] < 0.3 * before[2]
    for s in range(4):
        assert (np.diff(out[np.argsort(values[:, s]), s]) >= -1e-9).all()


def test_noob_formula(spark):
    rng = np.random.default_rng(8)
    oob = rng.normal(200, 30, 4000)
    signal = rng.normal(200, 30, 3000) + rng.exponential(900, 3000)
    mk = lambda v: spark.createDataFrame(pd.DataFrame({"sample_id": "s", "channel": "g", "id": range(len(v)), "value": v}))
    out = normalise.noob(mk(signal), mk(oob)).toPandas().sort_values("id")["value"].to_numpy() - 15
    mu, sd = np.median(oob), 1.4826 * np.median(np.abs(oob - np.median(oob)))
    alpha = max(signal.mean() - mu, 10)
    m = signal - mu - sd ** 2 / alpha
    want = m + sd * tails.normal_pdf(m / sd) / tails.normal_cdf(m / sd)
    assert np.allclose(out, want) and (out > 0).all()


def test_bmiq_brings_designs_together(spark):
    rng = np.random.default_rng(6)
    draw = lambda a, b, n: rng.beta(a, b, n)
    one = np.concatenate([draw(3, 40, 4000), draw(6, 6, 1500), draw(40, 3, 4000)])
    two = np.concatenate([draw(4, 24, 4000), draw(6, 6, 1500), draw(20, 4, 4000)])
    pdf = pd.DataFrame({"feature_id": range(19000), "sample_id": "s", "value": np.concatenate([one, two]),
                        "design": ["I"] * 9500 + ["II"] * 9500})
    out = bmiq.bmiq(spark.createDataFrame(pdf)).toPandas().sort_values("feature_id")["value"].to_numpy()
    assert np.allclose(out[:9500], one)
    order = np.argsort(two)
    assert (np.diff(out[9500:][order]) >= -1e-9).all() and out.min() >= 0 and out.max() <= 1
    for q in (0.1, 0.25, 0.75, 0.9):
        gap = abs(np.quantile(two, q) - np.quantile(one, q))
        assert abs(np.quantile(out[9500:], q) - np.quantile(one, q)) < 0.5 * gap


def _fit_over_all_bins(counts):
    """The mixture of one histogram with every bin in every round."""
    mid = (np.arange(bmiq.BINS) + 0.5) / bmiq.BINS
    lo, hi = bmiq.START_BORDERS
    resp = np.stack([mid <= lo, (mid > lo) & (mid < hi), mid >= hi]) * 0.98 + 0.01
    for _ in range(bmiq.ROUNDS):
        mass = resp * counts
        total = np.maximum(mass.sum(axis=1), 1e-9)
        mean = mass @ mid / total
        a, b = bmiq._moments_to_shape(mean, (mass * (mid - mean[:, None]) ** 2).sum(axis=1) / total)
        scale = [math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)]
        logp = (np.log(total / total.sum()) + scale)[:, None] + np.outer(a - 1, np.log(mid)) + np.outer(b - 1, np.log1p(-mid))
        new = np.exp(logp - logp.max(axis=0))
        new /= new.sum(axis=0)
        moved, resp = np.abs(new - resp).max(), new
        if moved < bmiq.SETTLED:
            break
    order = np.argsort(a / (a + b))
    return a[order], b[order], resp[order]


def _mapped_by_hand(one, two):
    """All points of the grid, one after the other."""
    (a1, b1, _), (a2, b2, resp) = _fit_over_all_bins(one), _fit_over_all_bins(two)
    mid, label, middle = (np.arange(bmiq.BINS) + 0.5) / bmiq.BINS, resp.argmax(axis=0), a2[1] / (a2[1] + b2[1])
    lo = max(mid[(label == 0) & (mid <= middle)], default=0.0)
    hi = min(mid[(label == 2) & (mid >= middle)], default=1.0)
    lo, hi = min(lo, hi), max(lo, hi)
    grid = np.arange(bmiq.BINS + 1) / bmiq.BINS
    low = tails.beta_quantile(tails.beta_cdf(grid, a2[0], b2[0]), a1[0], b1[0])
    high = 1 - tails.beta_quantile(tails.beta_cdf(1 - grid, b2[2], a2[2]), b1[2], a1[2])
    x0, x1 = grid[grid <= lo].max(), grid[grid >= hi].min()
    y0, y1 = low[grid <= lo].max(), high[grid >= hi].min()
    out = np.where(grid <= lo, low, np.where(grid >= hi, high, y0 + (grid - x0) * (y1 - y0) / (x1 - x0)))
    return np.maximum.accumulate(np.clip(out, 0, 1))


def test_bmiq_of_many_samples_is_that_of_each(spark, monkeypatch):
    rng = np.random.default_rng(8)
    parts, want = [], {}
    for k, n in enumerate((8, 40, 300, 3000, 12, 64)):
        one, two = (np.concatenate([rng.beta(a, b, n) for a, b in shapes])
                    for shapes in (((3, 40), (6, 6), (40, 3)), ((4, 24), (5, 6), (20, 4))))
        place = [np.minimum((v * bmiq.BINS).astype(int), bmiq.BINS - 1) for v in (one, two)]
        curve = _mapped_by_hand(*(np.bincount(v, minlength=bmiq.BINS) for v in place))
        inside = two * bmiq.BINS - place[1]
        want[k] = np.concatenate([one, curve[place[1]] + (curve[place[1] + 1] - curve[place[1]]) * inside])
        parts.append(pd.DataFrame({"feature_id": range(6 * n), "sample_id": k, "value": np.concatenate([one, two]),
                                   "design": ["I"] * 3 * n + ["II"] * 3 * n}))
    kept = []
    monkeypatch.setattr(bmiq, "materialise", lambda df, name, f=bmiq.materialise: kept.append(f(df, name)) or kept[-1])
    long = spark.createDataFrame(pd.concat(parts)).repartition(5)
    out = bmiq.bmiq(long).toPandas().sort_values(["sample_id", "feature_id"])
    for k, values in want.items():
        assert np.allclose(out.loc[out["sample_id"] == k, "value"], values, atol=1e-9, rtol=0)
    # Lines are kept for bins that hold values of the second design, not for all the bins of every sample.
    used = long.where("design = 'II'").selectExpr("sample_id", "floor(value * 1000)").distinct().count()
    assert kept[0].count() == used < len(want) * bmiq.BINS / 2


def test_bmiq_leaves_what_it_has_no_curve_for(spark):
    cells = ([(i, "a", (i + 0.5) / 40, "I" if i % 2 else "II") for i in range(40)]
             + [(i, "b", (i + 0.5) / 40, "II") for i in range(40)]
             + [(50, "a", 1.5, "II"), (51, "a", -0.25, "II"), (52, "a", None, "II"), (53, None, 0.5, "II"), (54, "c", None, "I")])
    long = spark.createDataFrame(cells, "feature_id int, sample_id string, value double, design string")
    out = {(r["sample_id"], r["feature_id"]): r["value"] for r in bmiq.bmiq(long).collect()}
    assert len(out) == len(cells)
    assert all(out[s, f] == v for f, s, v, d in cells if s != "a" or d == "I" or f >= 50)
    assert any(out[s, f] != v for f, s, v, d in cells if s == "a" and d == "II" and f < 50)


def _greedy_by_hand(bad):
    rows, cols = set(range(bad.shape[0])), set(range(bad.shape[1]))
    total, good = bad.sum(), bad.size - bad.sum()
    best, best_gain, removed, step = 0, 0.0, [], 0
    while bad[np.ix_(sorted(rows), sorted(cols))].sum():
        step += 1
        rc = {r: bad[r, sorted(cols)].sum() for r in rows}
        cc = {c: bad[sorted(rows), c].sum() for c in cols}
        r_top, c_top = max(rc.values()), max(cc.values())
        if r_top / len(cols) >= c_top / len(rows):
            gone = [("feature", r) for r in rows if rc[r] == r_top]
            rows -= {r for _, r in gone}
        else:
            gone = [("sample", c) for c in cols if cc[c] == c_top]
            cols -= {c for _, c in gone}
        removed += [(k, i, step) for k, i in gone]
        left = bad[np.ix_(sorted(rows), sorted(cols))]
        gain = (total - left.sum()) / total - (good - (left.size - left.sum())) / good
        if gain > best_gain:
            best, best_gain = step, gain
    return {(k, str(i)) for k, i, s in removed if s <= best}


def test_greedycut_equals_the_dense_loop(spark):
    rng = np.random.default_rng(3)
    bad = (rng.random((30, 12)) < 0.04)
    bad[4] |= rng.random(12) < 0.7
    bad[:, 7] |= rng.random(30) < 0.6
    pdf = _melt(np.zeros((30, 12)))
    pdf["detection"] = np.where(bad.ravel(), 0.9, 0.001)
    out = filters.greedycut(spark.createDataFrame(pdf)).collect()
    assert {(r["kind"], r["id"]) for r in out} == _greedy_by_hand(bad.astype(int))
    pdf["detection"] = 0.0
    assert filters.greedycut(spark.createDataFrame(pdf)).count() == 0


def test_feature_filters(spark):
    values = np.array([[1.0, 2, 3], [5, 5, 5], [1, np.nan, 2]])
    df = spark.createDataFrame(_melt(values)).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    assert {r[0] for r in filters.filter_na(df).select("feature_id").collect()} == {0, 1}
    assert {r[0] for r in filters.filter_na(df.where("NOT (feature_id = 0 AND sample_id = 1)")).select("feature_id").collect()} == {1}
    assert {r[0] for r in filters.filter_low_sd(df, 0.005).select("feature_id").collect()} == {0, 2}


def test_region_edges(spark):
    ann = spark.createDataFrame([(1, "c", 10), (2, "c", 20), (3, "c", 21), (4, "d", 15), (5, "c", 9), (6, "c", 40)],
                                "feature_id int, chrom string, pos int")
    reg = spark.createDataFrame([("A", "c", 10, 20), ("B", "c", 20, 39), ("C", "c", 0, 1000)],
                                "region_id string, chrom string, start int, end int")
    got = {(r["feature_id"], r["region_id"]) for r in regions.site_regions(ann, reg).collect()}
    assert got == {(1, "A"), (2, "A"), (2, "B"), (3, "B"), (1, "C"), (2, "C"), (3, "C"), (5, "C"), (6, "C")}


def test_wide_and_long(spark):
    wide = spark.createDataFrame([("p1", 1.0, 0.1, 2.0), ("p2", None, 0.2, 3.0)],
                                 "`PROBE_ID` string, `s1.AVG` double, `s1.P` double, `s2.AVG` double")
    long = wide_to_long(wide, "PROBE_ID", {".AVG": "value", ".P": "detection"})
    assert {tuple(r) for r in long.collect()} == {("p1", "s1", 1.0, 0.1), ("p1", "s2", 2.0, None),
                                                  ("p2", "s1", None, 0.2), ("p2", "s2", 3.0, None)}
    back = {tuple(r) for r in long_to_wide(long, ["s1", "s2"]).collect()}
    assert back == {("p1", 1.0, 2.0), ("p2", None, 3.0)}


def test_mad_and_pca(spark, study):
    df, values, *_ = study
    got = reduce.mad(df).toPandas().set_index("feature_id")["mad"].sort_index().to_numpy()
    want = 1.4826 * np.median(np.abs(values - np.median(values, axis=1, keepdims=True)), axis=1)
    assert np.allclose(got, want)
    scores = reduce.pca(df, 2).toPandas().sort_values("sample_id")[["pc1", "pc2"]].to_numpy()
    centred = (values - values.mean(axis=1, keepdims=True)).T
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_differential_features(study):
    df, values, batch, age, _ = study
    out = differential.diff_features(df.where("feature_id <> 3"), "batch", "b", "a", ["age"]).toPandas().sort_values("feature_id")
    use = np.isin(batch, ["a", "b"])
    x = np.stack([np.ones(use.sum()), (batch[use] == "b").astype(float), age[use]], axis=1)
    y = np.delete(values, 3, axis=0)[:, use]
    coef = np.linalg.lstsq(x, y.T, rcond=None)[0]
    rss = ((y.T - x @ coef) ** 2).sum(axis=0)
    t = coef[1] / np.sqrt(np.linalg.inv(x.T @ x)[1, 1] * rss / (use.sum() - 3))
    assert np.allclose(out["effect"], coef[1]) and np.allclose(out["statistic"], t)
    assert np.allclose(out["p_value"], tails.t_sf2(t, use.sum() - 3))
    ranks = pd.DataFrame({"d": out["mean_diff"].abs().rank(method="min", ascending=False),
                          "q": out["quot_log2"].abs().rank(method="min", ascending=False), "p": out["p_value"].rank(method="min")})
    assert (out["combined_rank"] == ranks.max(axis=1)).all()


def test_components_of_more_features_than_samples_keep_gappy_samples(spark):
    from cohortloom.operators.matrix import reduce as red

    rng = np.random.default_rng(4)
    values = rng.normal(size=(6, 3000)) * np.array([3, 1, 1, 1, 1, 1])[:, None]
    cells = [(f, f"s{s}", float(values[s, f])) for s in range(6) for f in range(3000)]
    df = spark.createDataFrame(cells, "feature_id int, sample_id string, value double")
    got = {r["sample_id"]: [r["pc1"], r["pc2"]] for r in red.pca(df, 2).collect()}
    centred = values - values.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    want = u[:, :2] * s[:2]
    have = np.array([got[f"s{i}"] for i in range(6)])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-6)
    flat = np.array([list(r)[1:] for r in sorted(red.mds(df, 5).collect())])
    apart = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(apart(flat), apart(values), atol=1e-6)
    gappy = df.where("not (sample_id = 's2' and feature_id % 7 = 0)")
    assert red.pca(gappy, 2).count() == 6 and red.cluster_samples(gappy, 2).count() == 6
    with pytest.raises(ValueError, match="without values"):
        red.pca(df.unionByName(spark.createDataFrame([(1, "none", None)], df.schema)), 2)
