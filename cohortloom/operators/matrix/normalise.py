"""Variance stabilisation and normalisation of long matrices.

Per-sample fits see only bounded summaries (moments, knots or histogram counts) made by
aggregation; cells are then changed by column expressions or Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators.joins import attach
from cohortloom.operators.ordering import exact_quantiles, row_index
from cohortloom.session import materialise

FEATURE, SAMPLE, VALUE = "feature_id", "sample_id", "value"


def vst_regression(long: DataFrame, p_cut: float = 0.01, sample: str = SAMPLE, value: str = VALUE,
                   stdev: str = "stdev", detection: str = "detection") -> DataFrame:
    """Per sample: slope c1 and intercept c2 of spread on level, and background variance c3 (mean
    variance of probes not detected; where all are detected, of those below the sample's mean level)."""
    means = long.groupBy(sample).agg(F.avg(value).alias("_level"))
    variance = F.col(stdev) * F.col(stdev)
    return attach(long, means, sample).groupBy(sample).agg(
        F.regr_slope(stdev, value).alias("c1"), F.regr_intercept(stdev, value).alias("c2"),
        F.coalesce(F.avg(F.when(F.col(detection) > p_cut, variance)),
                   F.avg(F.when(F.col(value) <= F.col("_level"), variance))).alias("c3"))


def vst(long: DataFrame, p_cut: float = 0.01, sample: str = SAMPLE, value: str = VALUE, stdev: str = "stdev",
        detection: str = "detection") -> DataFrame:
    """Replace the value by asinh((c2 + c1 y) / sqrt(c3)) / c1, with constant spread in theory.
    A sample whose spread does not grow gets the limit, y / sqrt(c3)."""
    joined = attach(long, vst_regression(long, p_cut, sample, value, stdev, detection), sample)
    y, c1, c2, root = F.col(value), F.col("c1"), F.col("c2"), F.sqrt("c3")
    stable = F.when(F.abs(c1) > 1e-12, F.asinh(F.try_divide(c2 + c1 * y, root)) / F.when(F.abs(c1) > 1e-12, c1)
                    ).otherwise(F.try_divide(y, root))
    return joined.withColumn(value, stable).select(*long.columns)


def quantile_normalise(long: DataFrame, feature: str = FEATURE, sample: str = SAMPLE, value: str = VALUE,
                       max_group: int | None = None) -> DataFrame:
    """Give every sample the same distribution: the mean over samples at each rank. Tied cells get
    the mean of their targets. Samples must have the same features."""
    long = materialise(long, "cells")
    ranked = materialise(row_index(long, [value, feature], [sample], "_rank", max_group), "ranked")
    target = ranked.groupBy("_rank").agg(F.avg(value).alias("_target"))
    placed = attach(ranked, target, "_rank")
    ties = placed.groupBy(sample, value).agg(F.avg("_target").alias("_target"))
    return (attach(long, ties, [sample, value])
            .withColumn(value, F.when(F.col(value).isNotNull(), F.col("_target"))).drop("_target"))


def closest_sample(long: DataFrame, feature: str = FEATURE, sample: str = SAMPLE, value: str = VALUE):
    """The id of the sample nearest to the mean profile (the smaller id on a tie). A sample needs values in
    half of all features to be chosen."""
    means = long.groupBy(feature).agg(F.avg(value).alias("_m"))
    n_features = means.where("_m is not null").count()
    far = attach(long, means, feature).groupBy(sample).agg(
        F.avg((F.col(value) - F.col("_m")) ** 2).alias("_d"), F.count(value).alias("_n"))
    found = far.where((F.col("_n") > 0) & (2 * F.col("_n") >= n_features)).orderBy("_d", sample).first()
    if found is None:
        raise ValueError("no sample has values in half of the features")
    return found[sample]


def _isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing fit by pooling neighbours."""
    pools: list[tuple[float, float, int]] = []
    for level, weight in zip(y, w):
        pool = (float(level), float(weight), 1)
        while pools and pools[-1][0] > pool[0]:
            last = pools.pop()
            mass = last[1] + pool[1]
            pool = ((last[0] * last[1] + pool[0] * pool[1]) / mass, mass, last[2] + pool[2])
        pools.append(pool)
    return np.concatenate([np.full(n, level) for level, _, n in pools])


def _end_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of a monotone cubic at its points: harmonic mean of the neighbouring chords."""
    if len(x) < 2:
        return np.ones(len(x))
    chord = np.diff(y) / np.diff(x)
    before, after = chord[:-1], chord[1:]
    with np.errstate(all="ignore"):
        inner = np.where((before > 0) & (after > 0), 2 * before * after / (before + after), 0.0)
    return np.concatenate([chord[:1], inner, chord[-1:]])


def _fit_curves():
    """Pandas function: from a sample's few weighted points to a monotone cubic curve."""

    @F.pandas_udf("x array<double>, y array<double>, m array<double>")
    def fit(points: pd.Series) -> pd.DataFrame:
        rows = []
        for cell in points:
            pts = np.array([[p["x"], p["y"], p["w"]] for p in cell if p["w"] > 0], float)
            pts = pts[np.argsort(pts[:, 0], kind="stable")]
            keep = np.concatenate([[True], np.diff(pts[:, 0]) > 1e-12 * np.maximum(1, np.abs(pts[1:, 0]))])
            x, w = pts[keep, 0], pts[keep, 2]
            y = _isotonic(pts[keep, 1], w)
            rows.append((x.tolist(), y.tolist(), _end_slopes(x, y).tolist()))
        return pd.DataFrame(rows, columns=["x", "y", "m"])

    return fit


def _on_curve(v: Column) -> Column:
    """Value of the attached curve (arrays x, y, m): cubic between its points, straight outside."""
    n = F.size("x")
    at = F.size(F.filter("x", lambda a: a <= v))
    lo, hi = F.greatest(at, F.lit(1)), F.least(F.greatest(at, F.lit(1)) + 1, n)
    x0, y0, m0 = (F.element_at(c, lo) for c in ("x", "y", "m"))
    x1, y1, m1 = (F.element_at(c, hi) for c in ("x", "y", "m"))
    h = x1 - x0
    t = F.try_divide(v - x0, h)
    cubic = ((2 * t * t * t - 3 * t * t + 1) * y0 + (t * t * t - 2 * t * t + t) * h * m0
             + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * h * m1)
    return F.when((at == 0) | (at >= n), y0 + m0 * (v - x0)).otherwise(cubic)


def rsn(long: DataFrame, knots: int = 24, feature: str = FEATURE, sample: str = SAMPLE, value: str = VALUE) -> DataFrame:
    """Map every sample onto the sample closest to the mean profile by a robust monotone curve.

    Cells count less the further their difference from the target is from the sample's usual
    one. The curve goes through the weighted means of at most ``knots`` + 1 value ranges; where
    the ranges are cut is only approximate, all cells enter the means.
    """
    long = materialise(long, "cells")  # read several times below
    target_id = closest_sample(long, feature, sample, value)
    target = long.where(F.col(sample) == F.lit(target_id)).select(feature, F.col(value).alias("_t"))
    cells = attach(long.select(feature, sample, F.col(value).alias("_v")), target, feature, "inner").dropna()
    diff = F.col("_t") - F.col("_v")
    probs = [(i + 1) / (knots + 1) for i in range(knots)]
    scale = cells.groupBy(sample).agg(F.percentile_approx("_v", probs, 2000).alias("_cuts"),
                                      F.avg(diff).alias("_dm"), F.stddev_samp(diff).alias("_ds"))
    off = (diff - F.col("_dm")) / F.col("_ds")
    weight = F.when(F.coalesce(F.col("_ds") > 1e-12, F.lit(False)), F.exp(-0.5 * off * off)).otherwise(1.0)
    binned = attach(cells, scale, sample).select(
        sample, F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_bin"), "_v", "_t", weight.alias("_w"))
    points = binned.groupBy(sample, "_bin").agg(
        F.sum("_w").alias("w"), (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("x"),
        (F.sum(F.col("_w") * F.col("_t")) / F.sum("_w")).alias("y")).where("w > 0")
    curves = points.groupBy(sample).agg(F.collect_list(F.struct("x", "y", "w")).alias("_p")).select(
        sample, _fit_curves()("_p").alias("c")).select(sample, "c.*")
    return attach(long, curves, sample).withColumn(value, _on_curve(F.col(value))).select(*long.columns)


def background(in_band: DataFrame, out_of_band: DataFrame, keys: Sequence[str], value: str = VALUE,
               floor: float = 10.0) -> DataFrame:
    """Per (sample, channel): robust mean and sd of the out-of-band signal, and the mean excess of the
    in-band signal over it (at least ``floor``)."""
    centre = exact_quantiles(out_of_band, keys, value, [0.5], ["mu"])
    dev = attach(out_of_band, centre, keys).select(*keys, F.abs(F.col(value) - F.col("mu")).alias("_d"))
    spread = exact_quantiles(dev, keys, "_d", [0.5], ["_mad"])
    level = in_band.groupBy(*keys).agg(F.avg(value).alias("_level"))
    joined = attach(attach(centre, spread, keys, "inner"), level, keys, "inner")
    return joined.select(*keys, "mu", (F.col("_mad") * 1.4826).alias("sigma"),
                         F.greatest(F.col("_level") - F.col("mu"), F.lit(float(floor))).alias("alpha"))


def noob(in_band: DataFrame, out_of_band: DataFrame, keys: Sequence[str] = (SAMPLE, "channel"), value: str = VALUE,
         offset: float = 15.0) -> DataFrame:
    """Expected signal given normal background (from out-of-band cells) plus exponential signal."""

    @F.pandas_udf("double")
    def signal(x: pd.Series, mu: pd.Series, sigma: pd.Series, alpha: pd.Series) -> pd.Series:
        s = sigma.to_numpy(float)
        with np.errstate(all="ignore"):
            shifted = x.to_numpy(float) - mu.to_numpy(float) - s ** 2 / alpha.to_numpy(float)
            expected = shifted + s * tails.hazard(shifted / s)
        return pd.Series(np.where(s > 0, expected, np.maximum(shifted, 0.0)) + offset, index=x.index)

    joined = attach(in_band, background(in_band, out_of_band, list(keys), value), list(keys))
    return joined.withColumn(value, signal(value, "mu", "sigma", "alpha")).select(*in_band.columns)
