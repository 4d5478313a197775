"""Analysis of variance: one-way from group moments, several terms in sequence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortloom.functions import tails
from cohortloom.functions.columns import factor_code
from cohortloom.operators.matrix.core import factor_levels
from cohortloom.operators.stats.ols import check_rank, cross_products
from cohortloom.session import materialise

SCHEMA = "term string, df long, sumsq double, meansq double, statistic double, p_value double"


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F > f) for the rows of a model table."""
    return pd.Series(tails.f_sf(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)), index=f.index)


def anova_oneway(df: DataFrame, y: str, group: str) -> DataFrame:
    """Between and within sums of squares over any number of groups, with F and its tail.

    Group moments fold map-side and are written once; what follows sees one row per group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y")).dropna()
    groups = materialise(rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("m"),
                                               F.var_pop("y").alias("v")), "groups")
    # Weighted moments of the group means give the between part without cancelling.
    grand = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    total = groups.withColumn("grand", grand).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    msb, msw = F.try_divide("ssb", df1), F.try_divide("ssw", df2)
    null = F.lit(None).cast("double")
    stat = F.try_divide(msb, msw)
    table = F.array(
        F.struct(F.lit(group).alias("term"), df1.alias("df"), F.col("ssb").alias("sumsq"), msb.alias("meansq"),
                 stat.alias("statistic"), F.col("p").alias("p_value")),
        F.struct(F.lit("Residuals").alias("term"), df2.alias("df"), F.col("ssw").alias("sumsq"), msw.alias("meansq"),
                 null.alias("statistic"), null.alias("p_value")))
    return total.withColumn("p", f_tail(stat, df1.cast("double"), df2.cast("double"))).select(
        F.explode(table).alias("r")).select("r.*")


def anova(df: DataFrame, y: str, terms: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Sequential table: each term's sum of squares after the terms before it."""
    cp = cross_products(df, y, terms, levels)
    check_rank(cp.names, cp.full[:-1, :-1])
    # The last row of the Cholesky factor holds the response along each orthogonalised column.
    root = np.linalg.cholesky(cp.full[:-1, :-1])
    along = np.linalg.solve(root, cp.full[:-1, -1])
    resid = max(float(cp.full[-1, -1] - along @ along), 0.0)
    resid_df = cp.n - len(cp.names)
    out = []
    for term in terms:
        at = [i for i, t in enumerate(cp.terms) if t == term]
        ss = float(np.sum(along[at] ** 2))
        ms = ss / len(at) if at else float("nan")
        f = ms / (resid / resid_df) if resid > 0 and resid_df > 0 else float("nan")
        p = float(tails.f_sf(f, len(at), resid_df)) if f == f else float("nan")
        out.append((term, len(at), ss, ms, f, p))
    out.append(("Residuals", resid_df, resid, resid / resid_df if resid_df > 0 else float("nan"), None, None))
    return df.sparkSession.createDataFrame(out, SCHEMA)


def anova_coded(df: DataFrame, response: str, terms: Sequence[str], response_levels: Sequence[str] | None = None,
                levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The table for a factor response taken as its level numbers."""
    found = list(response_levels) if response_levels else factor_levels(df, response)
    return anova(df.withColumn(response, factor_code(F.col(response), found)), response, terms, levels)
