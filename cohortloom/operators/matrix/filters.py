"""Feature and sample filters of long matrices, and sample quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach, drop_in, keep_in
from cohortloom.operators.ordering import exact_quantiles
from cohortloom.session import materialise

# Chromosome names of the sex chromosomes.
SEX_CHROMOSOMES = ["X", "Y", "chrX", "chrY"]


def filter_context(long: DataFrame, annotation: DataFrame, context: str = "CG", feature: str = "feature_id") -> DataFrame:
    """Drop features annotated with another context."""
    return drop_in(long, annotation.where(F.col("context") != context), key=feature)


def filter_snp(long: DataFrame, annotation: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Drop features that overlap any known variant."""
    return drop_in(long, annotation.where(F.col("snp_count") > 0), key=feature)


def filter_sex_chrom(long: DataFrame, annotation: DataFrame, chroms: Sequence[str] = SEX_CHROMOSOMES,
                     feature: str = "feature_id") -> DataFrame:
    """Drop features on the sex chromosomes."""
    return drop_in(long, annotation.where(F.col("chrom").isin(list(chroms))), key=feature)


def filter_na(long: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Keep features that have a value in every sample of the matrix."""
    n_samples = long.select(sample).distinct().agg(F.count("*")).scalar()
    whole = (long.groupBy(feature).agg(F.count(value).alias("_n"), F.count("*").alias("_rows"))
             .where((F.col("_n") == F.col("_rows")) & (F.col("_n") == n_samples)))
    return keep_in(long, whole, feature)


def filter_low_sd(long: DataFrame, cut: float = 0.005, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Keep features whose sample standard deviation reaches the cut."""
    return keep_in(long, long.groupBy(feature).agg(F.stddev_samp(value).alias("_sd")).where(F.col("_sd") >= cut), feature)


def sample_qc(long: DataFrame, p_cut: float = 0.05, sample: str = "sample_id", value: str = "value",
              detection: str = "detection") -> DataFrame:
    """Per sample: share of missing values, share of failed detections, and quartiles."""
    shares = long.groupBy(sample).agg(
        F.avg(F.col(value).isNull().cast("double")).alias("missing_rate"),
        F.avg((F.col(detection) > p_cut).cast("double")).alias("failed_rate"))
    quart = exact_quantiles(long, [sample], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    return attach(shares, quart, sample)


def greedycut(long: DataFrame, p_cut: float = 0.05, feature: str = "feature_id", sample: str = "sample_id",
              detection: str = "detection") -> DataFrame:
    """Features and samples to remove so that unreliable cells go at the least loss of reliable ones.

    Each round removes the features, or the samples, with the largest share of unreliable cells
    (all that tie for it). The rounds up to the one furthest above the diagonal of removed
    unreliable against removed reliable share are kept. Only the sparse table of unreliable
    cells is iterated on, and it is written anew every round; there are at most as many rounds
    as distinct counts. Returns (kind, id, step).
    """
    spark = long.sparkSession
    dims = long.agg(F.countDistinct(feature).alias("rows"), F.countDistinct(sample).alias("cols")).first()
    rows, cols = dims["rows"], dims["cols"]
    bad = materialise(long.where(F.col(detection) > p_cut).select(
        F.col(feature).cast("string").alias("feature"), F.col(sample).cast("string").alias("sample")).distinct(), "bad")
    unreliable = bad.count()
    reliable = rows * cols - unreliable
    steps: list[DataFrame] = []
    bad_left, best, best_gain, step = unreliable, 0, 0.0, 0
    while bad_left:
        step += 1
        top = {}
        sides = [bad.groupBy(k).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("ties"))
                 .orderBy(F.desc("n")).limit(1).withColumn("kind", F.lit(k)) for k in ("feature", "sample")]
        for row in sides[0].unionByName(sides[1]).collect():
            top[row["kind"]] = (row["n"], row["ties"])
        share = {"feature": top["feature"][0] / cols, "sample": top["sample"][0] / rows}
        kind = "feature" if share["feature"] >= share["sample"] else "sample"
        worst, ties = top[kind]
        gone = materialise(bad.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") == worst)
                           .select(F.lit(kind).alias("kind"), F.col(kind).alias("id"), F.lit(step).alias("step")), "cut")
        steps.append(gone)
        bad = materialise(drop_in(bad, gone, key=kind, other_key="id"), "bad")
        bad_left -= worst * ties
        if kind == "feature":
            rows -= ties
        else:
            cols -= ties
        gain = (unreliable - bad_left) / unreliable
        if reliable:
            gain -= (reliable - (rows * cols - bad_left)) / reliable
        if gain > best_gain:
            best, best_gain = step, gain
    if not best:
        return spark.createDataFrame([], "kind string, id string, step int")
    out = steps[0]
    for s in steps[1:best]:
        out = out.unionByName(s)
    return out
