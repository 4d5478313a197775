"""Sorting, numbering, z-scores, outlier flags, top rows and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach
from cohortloom.operators.ordering import row_index

__all__ = ["flag_outliers", "rank_cutoff", "row_index", "sample_n", "sort_nulls_last", "top_n", "zscore"]


def sort_nulls_last(df: DataFrame, *cols: str) -> DataFrame:
    """Sort with NULL at the end in either direction; a leading ``-`` means descending."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
                        for c in cols])


def zscore(df: DataFrame, value: str, per: str | Sequence[str] = (), out: str = "z") -> DataFrame:
    """(value - mean) / sample sd, per key or pooled over the whole frame.

    Mean and sd come from a combined aggregate joined back, not from a window over the key.
    """
    keys = [per] if isinstance(per, str) else list(per)
    stats = F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("_stats")
    if keys:
        joined = attach(df, df.groupBy(*keys).agg(stats), keys)
    else:
        joined = df.withColumn("_stats", df.agg(stats).scalar())
    z = F.try_divide(F.col(value) - F.col("_stats.mean"), F.col("_stats.sd"))
    return joined.withColumn(out, z).drop("_stats")


def flag_outliers(df: DataFrame, z: str, cut: float = 2.0, side: str = "both", out: str = "outlier") -> DataFrame:
    """True beyond the cut on both sides, or ``low`` / ``high`` only."""
    col = F.col(z)
    cond = {"both": F.abs(col) > cut, "low": col < -cut, "high": col > cut}[side]
    return df.withColumn(out, cond)


def top_n(df: DataFrame, col: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The n rows with the largest value, ties settled by the given columns."""
    return df.orderBy(F.col(col).desc_nulls_last(), *tie_break).limit(n)


def rank_cutoff(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose value is at most the n-th smallest one; ties at the cutoff all stay."""
    nth = df.select(col).where(F.col(col).isNotNull()).orderBy(col).limit(n).agg(F.max(col))
    return df.where(F.col(col) <= nth.scalar())


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """n rows without replacement, the same ones every run and in any engine: the smallest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)
