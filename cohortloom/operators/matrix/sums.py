"""Per-feature regression sums, and small solves on them.

A cell's covariates ride along as plain columns, so one map-side combined aggregation gives all
that a linear model per feature needs. Cells that lack the value or a covariate are left out
feature by feature, so incomplete matrices need no special case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortloom.operators.matrix.core import design


def plus(parts: Sequence[Column]) -> Column:
    return reduce(add, parts, F.lit(0.0))


def with_covariates(long: DataFrame, covariates: Sequence[str], levels: Mapping[str, Sequence] | None,
                    value: str = "value") -> tuple[DataFrame, list[str]]:
    """Add design columns ``_x0 ..`` (no intercept; factors against their first level) shifted by
    their means, and the value shifted by its mean as ``_v``, so that sums do not cancel."""
    if covariates:
        wide, names = design(long, covariates, levels, intercept=False, out="_x")
    else:
        wide, names = long, []
    cols = [f"_x{i}" for i in range(len(names))]
    wide = wide.withColumns({c: F.col("_x")[i] for i, c in enumerate(cols)}) if cols else wide
    means = wide.agg(F.avg(value).alias("v"), *[F.avg(c).alias(c) for c in cols]).first()
    shifted = wide.withColumns({"_v": F.col(value) - float(means["v"] or 0.0),
                                **{c: F.col(c) - float(means[c] or 0.0) for c in cols}})
    return (shifted.drop("_x") if cols else shifted), cols


def regression_sums(cells: DataFrame, by: Sequence[str], cols: Sequence[str], v: str = "_v") -> DataFrame:
    """n, sv, svv and, per covariate, sc_i, svc_i and scc_i_j (i <= j)."""
    whole = cells.dropna(subset=[v, *cols])
    x = [F.col(c) for c in cols]
    y = F.col(v)
    aggs = [F.count("*").alias("n"), F.sum(y).alias("sv"), F.sum(y * y).alias("svv")]
    for i, c in enumerate(x):
        aggs += [F.sum(c).alias(f"sc_{i}"), F.sum(y * c).alias(f"svc_{i}")]
        aggs += [F.sum(c * x[j]).alias(f"scc_{i}_{j}") for j in range(i, len(x))]
    return whole.groupBy(*by).agg(*aggs)


def within_sums(sums: DataFrame, feature: str, p: int) -> DataFrame:
    """Per feature, cross products around the means of its groups (batches): ``w_vv``, arrays
    ``w_vc`` (p) and ``w_cc`` (p x p), with the cell and group counts and the covariates' plain sums
    of squares ``t_cc`` (p)."""
    n = F.col("n")
    scc = lambda i, j: F.col(f"scc_{min(i, j)}_{max(i, j)}")
    aggs = [F.sum("n").alias("n_cells"), F.count("*").alias("n_groups"),
            F.sum(F.col("svv") - F.col("sv") * F.col("sv") / n).alias("w_vv"),
            F.array(*[F.sum(F.col(f"svc_{i}") - F.col("sv") * F.col(f"sc_{i}") / n) for i in range(p)]
                    ).cast("array<double>").alias("w_vc"),
            F.array(*[F.sum(scc(i, j) - F.col(f"sc_{i}") * F.col(f"sc_{j}") / n) for i in range(p) for j in range(p)]
                    ).cast("array<double>").alias("w_cc"),
            F.array(*[F.sum(scc(i, i)) for i in range(p)]).cast("array<double>").alias("t_cc")]
    return sums.groupBy(feature).agg(*aggs)


def stack_arrays(col: pd.Series, *shape: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in col]).reshape(len(col), *shape) if len(col) else np.zeros((0, *shape))


def coefficients(p: int):
    """Pandas function: the p slopes from ``w_cc`` and ``w_vc``, least-norm where they are dependent."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(w_cc: pd.Series, w_vc: pd.Series) -> pd.Series:
        a, b = stack_arrays(w_cc, p, p), stack_arrays(w_vc, p)
        return pd.Series(list(np.einsum("fij,fj->fi", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)), index=w_cc.index)

    return solve


def add_slopes(per_feature: DataFrame, p: int) -> DataFrame:
    """Add ``beta`` and the residual sum of squares ``rss``."""
    if p == 0:
        return per_feature.withColumns({"beta": F.array().cast("array<double>"), "rss": F.greatest("w_vv", F.lit(0.0))})
    fitted = per_feature.withColumn("beta", coefficients(p)("w_cc", "w_vc"))
    explained = plus([F.col("beta")[i] * F.col("w_vc")[i] for i in range(p)])
    return fitted.withColumn("rss", F.greatest(F.col("w_vv") - explained, F.lit(0.0)))
