"""From methylation values to region values, and the tests of one region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import joins
from cohortloom.operators.matrix import bmiq, combat, core, filters, regions
from cohortloom.operators.stats.anova import anova
from cohortloom.operators.stats.tukey import tukey_hsd
from cohortloom.session import materialise


def kept_samples(pheno: DataFrame, keep: Column, required: Sequence[str] = ("Sex", "AGE")) -> DataFrame:
    """Samples that meet the condition and have the required columns."""
    reasons = {"condition": ~F.coalesce(keep, F.lit(False)), **{f"no_{c}": F.col(c).isNull() for c in required}}
    return core.removal_reasons(pheno, reasons).where(F.size("removal_reason") == 0).drop("removal_reason")


def filtered_sites(long: DataFrame, annotation: DataFrame, p_cut: float = 0.05, min_sd: float = 0.005) -> DataFrame:
    """Drop sites by context, variants, sex chromosomes, unreliable detection, missing values and low
    variability, in that order. The last ones look at what the earlier ones left."""
    usable = annotation.where((F.col("context") == "CG") & (F.col("snp_count") == 0)
                              & ~F.col("chrom").isin(filters.SEX_CHROMOSOMES)).select("feature_id")
    cells = materialise(joins.keep_in(long, usable, "feature_id"), "usable")
    cut = filters.greedycut(cells, p_cut).where("kind = 'feature'").select("id")
    text = cells.withColumn("_id", F.col("feature_id").cast("string"))
    reliable = joins.drop_in(text, cut, key="_id", other_key="id").drop("_id")
    return filters.filter_low_sd(filters.filter_na(materialise(reliable, "reliable")), min_sd)


def region_values(sites: DataFrame, annotation: DataFrame, region_table: DataFrame, pheno: DataFrame,
                  batch: str = "Batch", keep_effects: Sequence[str] = ("Diagnosis", "Sex", "AGE"),
                  map_designs: bool = True) -> DataFrame:
    """Design-mapped sites averaged to regions, batch-corrected with the named effects kept."""
    mapped = sites
    if map_designs:
        mapped = bmiq.bmiq(joins.attach(sites, annotation.select("feature_id", "design"), "feature_id"))
    means = regions.region_mean(mapped.select("feature_id", "sample_id", "value"), annotation, region_table)
    long = materialise(means.select(F.col("region_id").alias("feature_id"), "sample_id", "value"), "regions")
    cells = core.with_pheno(long, pheno.select("sample_id", batch, *keep_effects))
    return combat.combat(cells, batch, keep_effects)


def region_tests(values: DataFrame, region: str, pheno: DataFrame, terms: Sequence[str] = ("Diagnosis", "Sex", "AGE"),
                 compare: str = "Sex") -> tuple[DataFrame, DataFrame]:
    """(sequential analysis of variance, all-pairs comparison) of one region's values."""
    frame = core.feature_frame(values.select("feature_id", "sample_id", "value"), {"y": region},
                               pheno.select("sample_id", *terms))
    return anova(frame, "y", terms), tukey_hsd(frame, "y", compare)
