"""From probe signals to one gene's adjusted, scored values per sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import complete_cases
from cohortloom.operators import joins, ranking
from cohortloom.operators.matrix import combat, core, covariates, normalise
from cohortloom.session import materialise


def adjusted_matrix(long: DataFrame, pheno: DataFrame, batch: str = "Batch", adjust_for: Sequence[str] = (),
                    levels: Mapping[str, Sequence] | None = None, stabilise: bool = True, p_cut: float = 0.01,
                    sample: str = "sample_id") -> DataFrame:
    """Stabilised, normalised, batch-corrected values of the samples with complete phenotype, with the
    listed covariates removed. ``pheno`` has the sample id, the batch and the covariates."""
    # Stabilisation fits each sample alone; normalisation must see just the cohort's samples.
    cohort = complete_cases(pheno.select(sample, batch, *adjust_for), [batch, *adjust_for])
    signal = core.subset_samples(long, cohort, sample)
    if stabilise:
        signal = normalise.vst(signal, p_cut)
    normal = materialise(normalise.rsn(signal.select("feature_id", sample, "value")), "normalised")
    cells = core.with_pheno(normal, cohort, sample)
    corrected = combat.combat(cells, batch, adjust_for, levels)
    if not adjust_for:
        return corrected
    return covariates.eb_remove_covariates(materialise(corrected, "corrected"), adjust_for, levels)


def gene_table(adjusted: DataFrame, symbols: DataFrame, gene: str, pheno: DataFrame, per: str = "feature",
               cut: float = 2.0, sample: str = "sample_id", platform: str | None = None) -> DataFrame:
    """The rows of one gene's probes: value, z-score (per probe, or pooled over them), outlier and low
    flags, and the phenotype; numbered by sample inside each platform."""
    probes = symbols.where(F.col("symbol") == gene).select("feature_id")
    cells = core.subset_features(adjusted.select("feature_id", sample, "value"), probes)
    scored = ranking.zscore(cells, "value", ["feature_id"] if per == "feature" else [], "z")
    flagged = ranking.flag_outliers(ranking.flag_outliers(scored, "z", cut), "z", cut, "low", "low_flag")
    full = joins.attach(flagged, pheno, sample)
    return ranking.row_index(full, [sample], ["feature_id", *([platform] if platform else [])], "Sample")


def with_sequencing(genes: DataFrame, sequencing: DataFrame, patients: DataFrame, center: str, gene: str,
                    key: str = "PIDN") -> DataFrame:
    """Left-join sequencing results of one center and gene, then the patient labels."""
    found = sequencing.where((F.col("Center") == center) & (F.col("Gene") == gene))
    return joins.natural_join(joins.natural_join(genes, found, "left"), patients.select(key, "Categorized_Diagnosis"), "left")


def request_report(requests: DataFrame, pheno: DataFrame, key: str = "PIDN", rin: str = "RIN", cut: float = 7) -> DataFrame:
    """Every request with ``status``: found, bad_rin or good_rin (missing, by RNA quality), or missing."""
    held = joins.attach(requests, pheno.select(key).distinct().withColumn("_held", F.lit(True)), key)
    status = (F.when(F.col("_held"), "found").when(F.col(rin) < cut, "bad_rin").when(F.col(rin) >= cut, "good_rin")
              .otherwise("missing"))
    return held.withColumn("status", status).drop("_held")
