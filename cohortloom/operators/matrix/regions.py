"""From sites to regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import matches
from cohortloom.functions.strings import strip_suffix
from cohortloom.operators.joins import attach, region_join


def site_regions(annotation: DataFrame, regions: DataFrame) -> DataFrame:
    """(feature_id, region_id) for every site inside a region; a site may be in several."""
    return region_join(annotation.select("feature_id", "chrom", "pos"), regions).select("feature_id", "region_id")


def region_mean(long: DataFrame, annotation: DataFrame, regions: DataFrame, value: str = "value",
                sample: str = "sample_id") -> DataFrame:
    """Mean value of a region's sites per sample. Sites meet regions once, before cells are joined."""
    cells = attach(long, site_regions(annotation, regions), "feature_id", "inner", nulls="never")
    return cells.groupBy("region_id", sample).agg(F.avg(value).alias(value), F.count(value).alias("n_sites"))


def clean_annotation(annotation: DataFrame, symbol: str = "symbol", sep: str = ";", cut: str = "-") -> DataFrame:
    """Drop regions without a symbol or with several, and cut the symbol's suffix."""
    one = annotation.where(F.col(symbol).isNotNull() & ~matches(F.col(symbol), sep))
    return one.withColumn(symbol, strip_suffix(F.col(symbol), cut))
