"""Subsetting, mapping, joining and shaping long matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach, keep_in
from cohortloom.operators.ordering import row_index


def subset_samples(long: DataFrame, samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Cells of the samples a cohort table lists."""
    return keep_in(long, samples, sample)


def subset_features(long: DataFrame, features: DataFrame | Sequence, feature: str = "feature_id") -> DataFrame:
    """Cells of the given features: a table, or a short list that becomes a pushed-down filter."""
    if isinstance(features, DataFrame):
        return keep_in(long, features, feature)
    return long.where(F.col(feature).isin(list(features)))


def combine(a: DataFrame, b: DataFrame, feature: str = "feature_id") -> DataFrame:
    """The samples of both matrices over the features of ``a``."""
    return a.unionByName(keep_in(b, a, feature))


def with_pheno(long: DataFrame, pheno: DataFrame, sample: str = "sample_id", how: str = "inner") -> DataFrame:
    """Attach sample columns by sample id."""
    return attach(long, pheno, sample, how)


def map_ids(long: DataFrame, mapping: DataFrame, feature: str, target: str, drop_unmapped: bool = False) -> DataFrame:
    """Replace feature ids through a mapping table; ids without a target stay NULL or are dropped."""
    pairs = mapping.select(feature, F.col(target).alias("_to"))
    out = attach(long, pairs, feature, "inner" if drop_unmapped else "left")
    return out.withColumn(feature, F.col("_to")).drop("_to")


def collapse_dups(long: DataFrame, by: Sequence[str] = ("feature_id", "sample_id"), value: str = "value") -> DataFrame:
    """One cell per (feature, sample): the mean over repeated ids."""
    return long.groupBy(*by).agg(F.avg(value).alias(value))


def feature_frame(long: DataFrame, features: Mapping[str, object], pheno: DataFrame, sample: str = "sample_id",
                  feature: str = "feature_id", value: str = "value") -> DataFrame:
    """One row per sample with a column for each named feature, joined to the sample columns."""
    picked = subset_features(long, list(features.values()), feature)
    wide = picked.groupBy(sample).agg(*[
        F.max(F.when(F.col(feature) == F.lit(f), F.col(value))).alias(name) for name, f in features.items()])
    return attach(wide, pheno, sample)


def removal_reasons(df: DataFrame, reasons: Mapping[str, Column], out: str = "removal_reason") -> DataFrame:
    """Add the list of reasons to remove a row; keep the rows where it is empty."""
    return df.withColumn(out, F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in reasons.items()])))


def default_levels(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Factor codes of a column without declared levels: sorted distinct values numbered from 1."""
    return row_index(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out=out)


def beta_to_m(beta: Column) -> Column:
    """log2(beta / (1 - beta)); NULL at and beyond the ends."""
    return F.when((beta > 0) & (beta < 1), F.log2(beta / (1 - beta)))


def center_on_group(long: DataFrame, in_group: Column, feature: str = "feature_id", value: str = "value",
                    out: str = "centered") -> DataFrame:
    """Value minus the feature's mean over the samples of one group."""
    means = long.groupBy(feature).agg(F.avg(F.when(in_group, F.col(value))).alias("_mean"))
    return attach(long, means, feature).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def factor_levels(df: DataFrame, col: str) -> list:
    """The sorted levels of a factor, for design columns."""
    return sorted(row[0] for row in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def design(df: DataFrame, terms: Sequence[str], levels: Mapping[str, Sequence] | None = None, intercept: bool = True,
           out: str = "x") -> tuple[DataFrame, list[str]]:
    """Add the design row as an array and return its column names.

    Text columns are factors coded against their first level; others enter as numbers. Rows
    with a missing term get a NULL design row.
    """
    names, cols = (["(Intercept)"], [F.lit(1.0)]) if intercept else ([], [])
    for term in terms:
        declared = (levels or {}).get(term)
        if declared is None and dict(df.dtypes)[term] == "string":
            declared = factor_levels(df, term)
        if declared is None:
            names.append(term)
            cols.append(F.col(term).cast("double"))
        else:
            for level in list(declared)[1:]:
                names.append(f"{term}{level}")
                cols.append(F.when(F.col(term).isNotNull(), (F.col(term) == F.lit(level)).cast("double")))
    whole = F.lit(True)
    for term in terms:
        whole = whole & F.col(term).isNotNull()
    return df.withColumn(out, F.when(whole, F.array(*cols))), names
