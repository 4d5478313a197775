"""First rows, repeats, duplicate groups, and stacking of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach, drop_in, keep_in
from cohortloom.operators.ordering import SortKey, row_index, sort_columns


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def first_per_key(df: DataFrame, key: str | Sequence[str], order_by: Sequence[SortKey]) -> DataFrame:
    """The first row of every key (NULL is a key). Spark cuts each task's share to one row per
    key before the shuffle, so a hot key sends one row per task."""
    w = W.partitionBy(*_keys(key)).orderBy(*sort_columns(order_by))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repeats(df: DataFrame, key: str | Sequence[str], order_by: Sequence[SortKey],
            max_group: int | None = None) -> DataFrame:
    """Every row but the first of its key."""
    return row_index(df, order_by, _keys(key), "_rn", max_group).where("_rn > 1").drop("_rn")


def dup_groups(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    keys = _keys(key)
    return keep_in(df, df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), keys)


def dup_count(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys (NULL is one) and surplus rows."""
    per_key = df.groupBy(*_keys(key)).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")
                       ).withColumn("n_surplus", F.col("n_rows") - F.col("n_distinct"))


def stack(dfs: Sequence[DataFrame] | Mapping[str, DataFrame], source_col: str | None = None) -> DataFrame:
    """Union by column name, duplicates kept; a mapping can record each row's source."""
    if isinstance(dfs, Mapping):
        frames = [d.withColumn(source_col, F.lit(name)) if source_col else d for name, d in dfs.items()]
    else:
        frames = list(dfs)
    return reduce(DataFrame.unionByName, frames)


def dedup_priority(dfs: Sequence[DataFrame], key: str | Sequence[str], order_by: Sequence[SortKey]) -> DataFrame:
    """Stack sources and keep one row per key: the earliest source's first row."""
    ranked = stack([d.withColumn("_source", F.lit(i)) for i, d in enumerate(dfs)])
    return first_per_key(ranked, key, [F.col("_source"), *order_by]).drop("_source")


def distinct_rows(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack and keep each whole row once."""
    return stack(dfs).distinct()


def union_prefer(primary: DataFrame, secondary: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """All of ``primary`` and those rows of ``secondary`` whose key ``primary`` lacks."""
    return primary.unionByName(drop_in(secondary, primary, key=key))


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct key values found in both."""
    return a.select(key).intersect(b.select(key))


def exclude_keys(df: DataFrame, key: str, cond, removed: bool = False) -> DataFrame:
    """Drop (or, with ``removed``, keep) every row of a key that has any row meeting ``cond``."""
    bad = df.where(F.coalesce(cond, F.lit(False))).select(key)
    return keep_in(df, bad, key) if removed else drop_in(df, bad, key=key)


def invalidate_key(df: DataFrame, key: str, cond, cols: Sequence[str]) -> DataFrame:
    """Blank columns on every row of a key that has any invalid row; a NULL test is not invalid."""
    bad = df.where(F.coalesce(cond, F.lit(False))).select(key).distinct().withColumn("_bad", F.lit(True))
    blank = {c: F.when(F.col("_bad").isNull(), F.col(c)) for c in cols}
    return attach(df, bad, key).withColumns(blank).drop("_bad")
