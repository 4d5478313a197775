"""All-pairs comparison of group means (Tukey, unequal sizes by Kramer)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.session import materialise


def _limits(level: float):
    @F.pandas_udf("half double, p double")
    def limits(q: pd.Series, se: pd.Series, k: pd.Series, df: pd.Series) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"half": [], "p": []}, dtype=float)
        groups, dof = int(k.iloc[0]), float(df.iloc[0])  # the same in every row of the table
        width = tails.tukey_quantile(level, groups, dof)
        p = np.clip(1 - tails.tukey_cdf(q.to_numpy(float), groups, dof), 0, 1)
        return pd.DataFrame({"half": width * se.to_numpy(float), "p": p})

    return limits


def tukey_hsd(df: DataFrame, y: str, group: str, level: float = 0.95) -> DataFrame:
    """One row per pair of levels: comparison, estimate, conf_low, conf_high, adj_p_value.

    Rows are folded to one record per level first; the pairs are of levels, and every level's pairs
    are made and tested by a task of their own.
    """
    rows = df.select(F.col(group).alias("g"), F.col(y).cast("double").alias("y")).dropna()
    groups = materialise(rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("y").alias("m"),
                                               F.var_pop("y").alias("v")), "groups")
    table = groups.agg(F.sort_array(F.collect_list(F.struct("g", "n", "m"))).alias("levels"),
                       F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"),
                       (F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count("*"))).alias("mse"))
    firsts = table.select("*", F.posexplode("levels").alias("at", "a")).repartition("at")
    pairs = firsts.select("k", "df", "mse", "a", F.explode(
        F.slice("levels", F.col("at") + 2, F.greatest(F.col("k").cast("int") - F.col("at") - 1, F.lit(0)))).alias("b"))
    est = pairs.select(
        F.lit(group).alias("term"), F.concat_ws("-", F.col("b.g").cast("string"), F.col("a.g").cast("string")).alias("comparison"),
        (F.col("b.m") - F.col("a.m")).alias("estimate"), "k", "df",
        F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n"))).alias("se"))
    out = est.withColumn("lim", _limits(level)(F.try_divide(F.abs("estimate"), F.col("se")), F.col("se"),
                                               F.col("k").cast("double"), F.col("df").cast("double")))
    return out.select("term", "comparison", "estimate", (F.col("estimate") - F.col("lim.half")).alias("conf_low"),
                      (F.col("estimate") + F.col("lim.half")).alias("conf_high"), F.col("lim.p").alias("adj_p_value"))
