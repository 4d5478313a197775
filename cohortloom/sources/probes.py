"""Wide probe tables to long matrices and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, id_col: str, layers: Mapping[str, str], feature: str = "feature_id",
                 sample: str = "sample_id") -> DataFrame:
    """One row per (feature, sample) from a table with one column group per sample.

    ``layers`` maps a column suffix to a layer name; the sample is the text before the suffix. A
    layer a sample lacks is NULL.
    """
    samples: dict[str, dict[str, str]] = {}
    for c in df.columns:
        for suffix, layer in layers.items():
            if c != id_col and c.endswith(suffix):
                samples.setdefault(c[:len(c) - len(suffix)], {})[layer] = c
                break
    names = list(layers.values())
    cells = [F.struct(F.lit(s).alias(sample),
                      *[(F.col(f"`{cols[n]}`") if n in cols else F.lit(None)).cast("double").alias(n) for n in names])
             for s, cols in samples.items()]
    return df.select(F.col(id_col).alias(feature), F.explode(F.array(*cells)).alias("_c")).select(feature, "_c.*")


def long_to_wide(df: DataFrame, samples: Sequence[str], value: str = "value", feature: str = "feature_id",
                 sample: str = "sample_id") -> DataFrame:
    """One row per feature and one column per listed sample (declared, so no scan finds them)."""
    return df.groupBy(feature).pivot(sample, list(samples)).agg(F.first(value, ignorenulls=True))
