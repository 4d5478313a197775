"""Empirical-Bayes batch correction (location and scale per batch, shrunk over features)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach
from cohortloom.operators.matrix.sums import add_slopes, plus, regression_sums, with_covariates, within_sums
from cohortloom.session import materialise


def _check_covariates(within: DataFrame, p: int) -> None:
    """Raise where covariates are explained by the batches or by each other. The features with
    most cells have all samples, so one of them shows it."""
    row = within.orderBy(F.desc("n_cells")).select("w_cc", "t_cc").first()
    if row is None:
        return
    cc = np.array(row["w_cc"], float).reshape(p, p)
    scale = np.sqrt(np.abs(np.diag(cc)))
    if (np.any(scale ** 2 <= 1e-10 * np.array(row["t_cc"], float))
            or np.linalg.matrix_rank(cc / np.outer(scale, scale), tol=1e-9) < p):
        raise ValueError("covariates are confounded with the batches or with each other")


def _fixed_point(conv: float, rounds: int):
    """Pandas function: shrunken location and scale of each (feature, batch), iterated together
    until each row's relative change is below ``conv``."""

    @F.pandas_udf("gamma double, delta double")
    def iterate(n: pd.Series, s1: pd.Series, s2: pd.Series, gbar: pd.Series, t2: pd.Series, a: pd.Series,
                b: pd.Series) -> pd.DataFrame:
        n, s1, s2, gbar, t2, a, b = (c.to_numpy(float) for c in (n, s1, s2, gbar, t2, a, b))
        with np.errstate(all="ignore"):
            ghat = s1 / n
            dhat = (s2 - n * ghat ** 2) / (n - 1)
            t2 = np.where(np.isfinite(t2), t2, 0.0)
            single = n < 2
            # One sample has no spread: location only. Without spread of the scales over the
            # features there is nothing to shrink to, and the batch's own scale stands.
            own_scale = ~single & ~np.isfinite(a)
            g, d = ghat.copy(), np.where(single, 1.0, dhat)
            moving = np.isfinite(g) & np.isfinite(d)
            for _ in range(rounds):
                g_new = (t2 * n * ghat + d * gbar) / (t2 * n + d)
                g_new = np.where(t2 * n + d > 0, g_new, ghat)
                rest = s2 - 2 * g_new * s1 + n * g_new ** 2
                d_new = (0.5 * rest + b) / (n / 2 + a - 1)
                d_new = np.where(single, 1.0, np.where(own_scale, dhat, d_new))
                step = np.fmax(np.abs((g_new - g) / np.where(g == 0, 1.0, g)), np.abs((d_new - d) / np.where(d == 0, 1.0, d)))
                g, d = np.where(moving, g_new, g), np.where(moving, d_new, d)
                moving = moving & (step > conv)
                if not moving.any():
                    break
        return pd.DataFrame({"gamma": g, "delta": d})

    return iterate


def batch_parameters(cells: DataFrame, batch: str, cols: Sequence[str], feature: str, conv: float = 1e-4,
                     rounds: int = 1000) -> DataFrame:
    """One row per (feature, batch): mean, slopes and sd of the feature, and raw and shrunken batch
    location and scale. Everything follows from one aggregation of the cells."""
    p = len(cols)
    sums = materialise(regression_sums(cells, [feature, batch], cols), "sums")
    within = within_sums(sums, feature, p)
    if p:
        _check_covariates(within, p)
    fits = add_slopes(within, p)
    joined = attach(sums, fits.select(feature, "beta", "rss", "n_cells", "n_groups"), feature)
    n = F.col("n")
    beta = [F.col("beta")[i] for i in range(p)]
    level = F.col("sv") - plus([beta[i] * F.col(f"sc_{i}") for i in range(p)])  # n_b times the batch's intercept
    # The overall mean weights batches by their cells.
    means = joined.groupBy(feature).agg((F.sum(level) / F.max("n_cells")).alias("alpha"))
    joined = attach(joined, means, feature).withColumn("sigma", F.sqrt(F.col("rss") / F.col("n_cells")))
    alpha = F.col("alpha")
    dev1 = level - n * alpha
    quad = plus([beta[i] * beta[j] * F.col(f"scc_{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    dev2 = (F.col("svv") + n * alpha * alpha + quad - 2 * alpha * F.col("sv")
            - 2 * plus([beta[i] * F.col(f"svc_{i}") for i in range(p)])
            + 2 * alpha * plus([beta[i] * F.col(f"sc_{i}") for i in range(p)]))
    # A constant feature, or one seen in one batch only, is passed through.
    usable = (F.col("n_groups") > 1) & (F.col("rss") > 1e-12 * F.abs(F.col("svv")))
    std = joined.select(
        feature, batch, n, alpha, "beta", "sigma", usable.alias("usable"),
        F.when(usable, dev1 / F.col("sigma")).alias("s1"),
        F.when(usable, F.greatest(dev2, F.lit(0.0)) / (F.col("sigma") * F.col("sigma"))).alias("s2"))
    std = std.withColumns({"gamma_hat": F.col("s1") / n, "delta_hat": F.when(
        F.col("usable") & (n > 1), F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / n, F.lit(0.0)) / (n - 1))})
    std = materialise(std, "standardised")
    priors = std.groupBy(batch).agg(
        F.avg("gamma_hat").alias("gbar"), F.var_samp("gamma_hat").alias("t2"),
        F.avg("delta_hat").alias("m"), F.var_samp("delta_hat").alias("v"))
    m, v = F.col("m"), F.col("v")
    nan = F.lit(float("nan"))
    priors = priors.withColumns({"a": F.when(v > 0, (2 * v + m * m) / v).otherwise(nan),
                                 "b": F.when(v > 0, (m * v + m * m * m) / v).otherwise(nan)}).drop("m", "v")
    shrunk = attach(std, priors, batch).withColumn(
        "fit", _fixed_point(conv, rounds)("n", "s1", "s2", "gbar", "t2", "a", "b"))
    return shrunk.select(feature, batch, "usable", "alpha", "beta", "sigma", "gamma_hat", "delta_hat",
                         F.col("fit.gamma").alias("gamma"), F.col("fit.delta").alias("delta"))


def _standardise(cells: DataFrame, params: DataFrame, batch: str, cols: Sequence[str], feature: str):
    joined = attach(cells, params, [feature, batch])
    fitted = F.col("alpha") + plus([F.col("beta")[i] * F.col(c) for i, c in enumerate(cols)])
    return joined, fitted, (F.col("_v") - fitted) / F.col("sigma")


def combat(long: DataFrame, batch: str = "batch", covariates: Sequence[str] = (),
           levels: Mapping[str, Sequence] | None = None, feature: str = "feature_id", value: str = "value",
           conv: float = 1e-4) -> DataFrame:
    """Replace the value by its batch-corrected one, keeping covariate effects.

    ``batch`` and the covariates are columns of the long frame (attach sample columns first).
    Missing values stay missing.
    """
    cells, cols = with_covariates(long, covariates, levels, value)
    params = batch_parameters(cells, batch, cols, feature, conv).drop("gamma_hat", "delta_hat")
    joined, fitted, z = _standardise(cells, params, batch, cols, feature)
    corrected = (F.col("sigma") * (z - F.col("gamma")) / F.sqrt("delta") + fitted) + (F.col(value) - F.col("_v"))
    keep = ~F.coalesce(F.col("usable"), F.lit(False)) | F.coalesce(F.col("delta") <= 0, F.lit(True))
    return joined.withColumn(value, F.when(keep, F.col(value)).otherwise(corrected)).select(*long.columns)


def combat_standardise(long: DataFrame, batch: str = "batch", covariates: Sequence[str] = (),
                       levels: Mapping[str, Sequence] | None = None, feature: str = "feature_id",
                       value: str = "value") -> DataFrame:
    """The standardised cells and raw batch effects that the shrinkage starts from."""
    cells, cols = with_covariates(long, covariates, levels, value)
    joined, _, z = _standardise(cells, batch_parameters(cells, batch, cols, feature), batch, cols, feature)
    return joined.withColumn("z", F.when(F.col("usable"), z)).select(*long.columns, "z", "gamma_hat", "delta_hat")
