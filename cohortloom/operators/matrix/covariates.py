"""Covariate removal per feature: least squares, and with coefficients shrunk over features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortloom.functions import tails
from cohortloom.operators.joins import attach
from cohortloom.operators.matrix.sums import (add_slopes, plus, regression_sums, stack_arrays, with_covariates,
                                              within_sums)
from cohortloom.session import materialise


def _feature_fits(cells: DataFrame, cols: Sequence[str], feature: str) -> DataFrame:
    sums = regression_sums(cells, [feature], cols)
    means = F.array(*[F.col(f"sc_{i}") / F.col("n") for i in range(len(cols))])
    fits = add_slopes(within_sums(sums.withColumn("xbar", means), feature, len(cols)), len(cols))
    return attach(fits, sums.select(feature, means.alias("xbar")), feature)


def _remove(cells: DataFrame, fits: DataFrame, slopes: str, cols: Sequence[str], feature: str, value: str,
            keep: Sequence[str]) -> DataFrame:
    joined = attach(cells, fits.select(feature, "xbar", F.col(slopes).alias("_slope")), feature)
    effect = plus([(F.col(c) - F.col("xbar")[i]) * F.col("_slope")[i] for i, c in enumerate(cols)])
    return joined.withColumn(value, F.col(value) - effect).select(*keep)


def ols_residualise(long: DataFrame, covariates: Sequence[str], levels: Mapping[str, Sequence] | None = None,
                    feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Subtract each feature's fitted covariate effects, keeping its mean."""
    cells, cols = with_covariates(long, covariates, levels, value)
    return _remove(cells, _feature_fits(cells, cols, feature), "beta", cols, feature, value, long.columns)


def _variance_prior(mean_log: float, var_log: float, dof: float) -> tuple[float, float]:
    """(prior degrees of freedom, prior variance) from the moments of log residual variances."""
    centre = mean_log - tails.digamma(dof / 2) + math.log(dof / 2)
    extra = var_log - tails.trigamma(dof / 2)
    if not extra > 0:
        return math.inf, math.exp(centre)
    d0 = 2 * tails.trigamma_inverse(extra)
    return d0, math.exp(centre + tails.digamma(d0 / 2) - math.log(d0 / 2))


def eb_remove_covariates(long: DataFrame, covariates: Sequence[str], levels: Mapping[str, Sequence] | None = None,
                         feature: str = "feature_id", value: str = "value", prior_scale: float = 1.0) -> DataFrame:
    """Subtract covariate effects whose slopes are shrunk to their mean over the features.

    Priors come from moments over all features (p and p x p numbers); ``prior_scale`` widens
    the slope prior, and as it grows the result tends to plain least squares.
    """
    cells, cols = with_covariates(long, covariates, levels, value)
    p = len(cols)
    fits = materialise(_feature_fits(cells, cols, feature).withColumn(
        "dof", F.col("n_cells") - p - 1).withColumn("s2", F.when(F.col("dof") > 0, F.col("rss") / F.col("dof"))), "fits")

    @F.pandas_udf(ArrayType(DoubleType()))
    def sampling(w_cc: pd.Series, s2: pd.Series) -> pd.Series:
        inv = np.linalg.pinv(stack_arrays(w_cc, p, p), rcond=1e-12, hermitian=True)
        return pd.Series(list((inv * s2.to_numpy(float)[:, None, None]).reshape(len(s2), p * p)), index=w_cc.index)

    usable = fits.where((F.col("dof") > 0) & (F.col("s2") > 0)).withColumn("cov", sampling("w_cc", "s2"))
    b = [F.col("beta")[i] for i in range(p)]
    row = usable.agg(F.count("*").alias("n"), F.avg("dof").alias("dof"), F.avg(F.log("s2")).alias("ml"), F.var_samp(F.log("s2")).alias("vl"),
                     *[F.avg(b[i]).alias(f"m{i}") for i in range(p)],
                     *[F.covar_samp(b[i], b[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(p)],
                     *[F.avg(F.col("cov")[i * p + j]).alias(f"v{i}_{j}") for i in range(p) for j in range(p)]).first()
    if row["n"] < 2:
        return _remove(cells, fits, "beta", cols, feature, value, long.columns)
    mu = np.array([row[f"m{i}"] for i in range(p)])
    spread = np.array([[row[f"c{i}_{j}"] - row[f"v{i}_{j}"] for j in range(p)] for i in range(p)])
    eig, vec = np.linalg.eigh(0.5 * (spread + spread.T))
    prior = (vec * np.clip(eig, 0, None)) @ vec.T * prior_scale
    if prior_scale > 1:
        prior = prior + np.eye(p) * (prior_scale - 1) * 1e-6
    d0, s0 = _variance_prior(row["ml"], row["vl"] or 0.0, row["dof"])

    @F.pandas_udf(ArrayType(DoubleType()))
    def shrink(beta: pd.Series, w_cc: pd.Series, s2: pd.Series, dof: pd.Series) -> pd.Series:
        est, cc = stack_arrays(beta, p), stack_arrays(w_cc, p, p)
        s, d = np.nan_to_num(s2.to_numpy(float)), np.maximum(dof.to_numpy(float), 0)
        post = np.full_like(s, s0) if math.isinf(d0) else (d0 * s0 + d * s) / (d0 + d)
        cov = np.linalg.pinv(cc, rcond=1e-12, hermitian=True) * post[:, None, None]
        gain = prior @ np.linalg.pinv(prior + cov, rcond=1e-14, hermitian=True)
        return pd.Series(list(mu + np.einsum("fij,fj->fi", gain, est - mu)), index=beta.index)

    shrunk = fits.withColumn("shrunk", shrink("beta", "w_cc", "s2", "dof"))
    return _remove(cells, shrunk, "shrunk", cols, feature, value, long.columns)
