"""Two-group comparison of every feature and every region of features, adjusted for covariates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators.joins import attach
from cohortloom.operators.matrix.reduce import group_means
from cohortloom.operators.matrix.sums import (add_slopes, plus, regression_sums, stack_arrays, with_covariates,
                                              within_sums)
from cohortloom.operators.ordering import ordered_pieces, rank_of, row_index, value_places
from cohortloom.session import materialise

REGION_SITES = 2048        # sites of a region whose product is taken in one task,
REGION_CELLS = 1 << 24     # and cells; larger regions are added up over chunks of sites
SAMPLE_BLOCK = 256         # samples of a block of the product of samples


def diff_features(long: DataFrame, group: str, first: str, second: str, covariates: Sequence[str] = (),
                  levels: Mapping[str, Sequence] | None = None, feature: str = "feature_id",
                  value: str = "value") -> DataFrame:
    """Per feature: group means, difference, log2 quotient, adjusted p value of the group effect, and
    ``combined_rank``, the worst of the ranks by difference, quotient and p (1 is best)."""
    pair, cells, cols = _pair(long, group, first, second, covariates, levels, value)
    tested = _tests(_fits(cells, cols, feature), len(cols)).select(feature, "effect", "statistic", "p_value")
    table = materialise(attach(group_means(pair, F.col(group) == first, feature, value), tested, feature), "tests")
    return worst_rank(table, "mean_diff", "quot_log2", "p_value")


def worst_rank(table: DataFrame, difference: str, quotient: str, p: str) -> DataFrame:
    """Add ``combined_rank``, the worst of the ranks by size of difference, size of quotient and p."""
    sized = table.withColumns({"_d": F.abs(difference), "_q": F.abs(quotient)})
    ranked = rank_of(rank_of(rank_of(sized, "_d", "_rd", descending=True), "_q", "_rq", descending=True), p, "_rp")
    return ranked.withColumn("combined_rank", F.greatest("_rd", "_rq", "_rp")).drop("_d", "_q", "_rd", "_rq", "_rp")


def _pair(long, group, first, second, covariates, levels, value):
    """The cells of the two groups, and with design columns (the group first) and their names."""
    pair = long.where(F.col(group).isin(first, second))
    cells, cols = with_covariates(pair, [group, *covariates], {**(levels or {}), group: [second, first]}, value)
    return pair, cells, cols


def _fits(cells: DataFrame, cols: Sequence[str], feature: str) -> DataFrame:
    """Slopes, residual sums of squares and means of every feature."""
    sums, p = regression_sums(cells, [feature], cols), len(cols)
    centre = F.array(*[F.col(f"sc_{i}") / F.col("n") for i in range(p)])
    means = sums.withColumns({"_ybar": F.col("sv") / F.col("n"), "_xbar": centre})
    return attach(add_slopes(within_sums(sums, feature, p), p), means.select(feature, "_ybar", "_xbar", "svv"), feature)


def _tests(fits: DataFrame, p: int) -> DataFrame:
    """Add effect, statistic and p_value of the first design column."""

    @F.pandas_udf("effect double, statistic double, p_value double")
    def test(beta: pd.Series, w_cc: pd.Series, rss: pd.Series, n: pd.Series) -> pd.DataFrame:
        dof = n.to_numpy(float) - p - 1
        inv = np.linalg.pinv(stack_arrays(w_cc, p, p), rcond=1e-12, hermitian=True)
        est = stack_arrays(beta, p)[:, 0] if len(beta) else np.zeros(0)
        with np.errstate(all="ignore"):
            stat = est / np.sqrt(inv[:, 0, 0] * rss.to_numpy(float) / dof)
            pv = np.where(dof > 0, tails.t_sf2(np.nan_to_num(stat), np.maximum(dof, 1)), np.nan)
        return pd.DataFrame({"effect": est, "statistic": stat, "p_value": pv})

    return fits.withColumn("_t", test("beta", "w_cc", "rss", "n_cells")).select("*", "_t.*").drop("_t")


def adjusted_p(table: DataFrame, p: str, out: str, max_group: int | None = None) -> DataFrame:
    """Add the false discovery rate at which a row is called: the least p * m / rank of its own or any larger p, tied p
    sharing their last rank; NULL (and NaN) p stay out of m and get NULL.

    Ranks come from counts per distinct p. The running minimum goes over pieces of the order from the top down: one
    minimum per piece ties them together, so no task holds all rows.
    """
    valid = F.when(~F.isnan(p), F.col(p))
    places = value_places(table.select(F.lit(1).alias("_all"), valid.alias("_p")).where("_p is not null"), ["_all"], "_p", "_p", max_group)
    pieces = materialise(ordered_pieces(places, ["_all"], ["_p"], max_group), "places")
    m = pieces.agg(F.max("_hi")).first()[0] or 0
    rate = pieces.withColumn("_q", F.least(F.lit(1.0), F.col("_p") * F.lit(float(m)) / F.col("_hi")))
    later = W.orderBy(F.col("_piece").desc()).rowsBetween(W.unboundedPreceding, -1)
    above = rate.groupBy("_piece").agg(F.min("_q").alias("_m")).select("_piece", F.min("_m").over(later).alias("_above"))
    inside = W.partitionBy("_piece").orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, 0)
    called = attach(rate.withColumn("_least", F.min("_q").over(inside)), above, "_piece").select(
        "_p", F.least("_least", F.coalesce("_above", F.lit(1.0))).alias(out))
    return attach(table.withColumn("_p", valid), called, "_p", nulls="never").drop("_p")


def _squared_correlations(table: pa.Table) -> float:
    """Sum of squared correlations over all pairs of sites (and each with itself) from their unit residual vectors."""
    at = table["at"].combine_chunks()
    row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
    column = at.flatten().to_numpy(zero_copy_only=False)
    z = table["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    product = np.zeros((len(at), len(at)))
    for start in range(0, int(column.max(initial=-1)) + 1, SAMPLE_BLOCK):
        here = (column >= start) & (column < start + SAMPLE_BLOCK)
        dense = np.zeros((len(at), SAMPLE_BLOCK))
        dense[row[here], column[here] - start] = z[here]
        product += dense @ dense.T
    return float((product ** 2).sum())


def region_correlation(residuals: DataFrame, membership: DataFrame, samples: int, feature: str, region: str,
                       limit: int | None = None) -> DataFrame:
    """(region, _f): the sum of squared correlations over all ordered pairs of a region's sites, themselves included.

    ``residuals``: (feature, at, z), one row per site with the places of its samples and residuals of unit length.
    A region of up to ``limit`` sites is one task's product of sites. In larger ones the same sum is that of the squared
    entries of the product of samples, which adds up over sites: chunks of sites give it block by block, blocks are
    added, then squared. No pair of sites is ever a row.
    """
    limit = limit or max(min(REGION_SITES, REGION_CELLS // max(samples, 1)), 1)
    sized = membership.groupBy(region).agg(F.count("*").alias("_k"))
    rows = materialise(attach(attach(membership, sized, region, "inner"), residuals, feature, "inner").select(
        F.col(region).alias("_region"), "_k", F.xxhash64(feature).alias("_hash"), "at", "z"), "residuals")
    kind = membership.schema[region].dataType.simpleString()

    def narrow(table: pa.Table) -> pa.Table:
        return pa.table({"_region": table["_region"].slice(0, 1), "_f": pa.array([_squared_correlations(table)])})

    few = rows.where(F.col("_k") <= limit).select("_region", "at", "z").groupBy("_region").applyInArrow(
        narrow, f"_region {kind}, _f double")
    if rows.where(F.col("_k") > limit).isEmpty():
        return few.withColumnRenamed("_region", region)
    blocks = -(-samples // SAMPLE_BLOCK)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)])
    of_block = lambda x, b: F.floor(x["at"] / SAMPLE_BLOCK) == b
    cut = rows.where(F.col("_k") > limit).withColumn("_chunk", F.pmod("_hash", F.ceil(F.col("_k") / limit))).select(
        "_region", "_chunk", F.arrays_zip("at", "z").alias("cells"), F.explode(pairs).alias("b")).select(
        "_region", "_chunk", "b.i", "b.j", F.filter("cells", lambda x: of_block(x, F.col("b.i")) | of_block(x, F.col("b.j"))).alias("cells"))
    flat = cut.select("_region", "_chunk", "i", "j", F.col("cells.at").alias("at"), F.col("cells.z").alias("z"))

    def block(table: pa.Table) -> pa.Table:
        at = table["at"].combine_chunks()
        row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
        column = at.flatten().to_numpy(zero_copy_only=False)
        z = table["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sides = []
        for b in (table["i"][0].as_py(), table["j"][0].as_py()):
            here = column // SAMPLE_BLOCK == b
            dense = np.zeros((len(at), SAMPLE_BLOCK))
            dense[row[here], column[here] % SAMPLE_BLOCK] = z[here]
            sides.append(dense)
        product = (sides[0].T @ sides[1]).ravel()
        some = np.flatnonzero(product)
        n = len(some)
        return pa.table({"_region": pa.array([table["_region"][0].as_py()] * n, table["_region"].type),
                         "i": pa.array(np.full(n, table["i"][0].as_py(), np.int32)), "j": pa.array(np.full(n, table["j"][0].as_py(), np.int32)),
                         "cell": pa.array(some), "g": pa.array(product[some])})

    parts = flat.groupBy("_region", "_chunk", "i", "j").applyInArrow(block, f"_region {kind}, i int, j int, cell long, g double")
    entries = parts.groupBy("_region", "i", "j", "cell").agg(F.sum("g").alias("g"))
    many = entries.groupBy("_region").agg(F.sum(F.col("g") * F.col("g") * F.when(F.col("i") == F.col("j"), 1).otherwise(2)).alias("_f"))
    return few.union(many).withColumnRenamed("_region", region)


def combined_p(sites: DataFrame, correlation: DataFrame, membership: DataFrame, feature: str, region: str) -> DataFrame:
    """(region, n_tested, comb_p): one p value per region from the p values of its sites, by Fisher's statistic on
    a scaled chi-squared law that allows for correlated sites.

    The statistic X sums -2 log p over k sites. Two of its terms covary by about 4 r^2 (exactly so for r = 0 and 1), so
    its variance is 4 F with F the sum of all squared correlations, and X k / F is chi-squared with 2 k^2 / F degrees
    of freedom: Fisher's own test for unrelated sites, the test of a single site for equal ones.
    """
    x = attach(membership, sites.select(feature, "p_value"), feature, "inner").groupBy(region).agg(
        F.count("*").alias("n_tested"), F.sum(-2 * F.log(F.greatest("p_value", F.lit(1e-300)))).alias("_x"))

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series, f: pd.Series) -> pd.Series:
        k, f = k.to_numpy(float), f.to_numpy(float)
        return pd.Series(tails.chi2_sf(x.to_numpy(float) * k / f, 2 * k * k / f), index=x.index)

    return attach(x, correlation, region, "inner").withColumn(
        "comb_p", tail("_x", F.col("n_tested").cast("double"), F.greatest("_f", F.col("n_tested").cast("double")))).select(region, "n_tested", "comb_p")


def region_means(features: DataFrame, membership: DataFrame, feature: str = "feature_id", region: str = "region_id") -> DataFrame:
    """Per region: number of sites, and the means of its sites' group means, differences and quotients."""
    return attach(membership, features, feature, "inner").groupBy(region).agg(
        F.count("*").alias("n_sites"), *[F.avg(c).alias(c) for c in ("mean_g1", "mean_g2", "mean_diff", "quot_log2")])


def diff_regions(long: DataFrame, membership: DataFrame, group: str, first: str, second: str, covariates: Sequence[str] = (),
                 levels: Mapping[str, Sequence] | None = None, feature: str = "feature_id", sample: str = "sample_id",
                 value: str = "value", region: str = "region_id", limit: int | None = None) -> DataFrame:
    """Per region: n_sites, means over its sites of group means, difference and log2 quotient, ``comb_p`` of the group
    effect over all its sites with covariates taken out, ``comb_p_adj`` (false discovery rate) and ``combined_rank``.

    ``membership``: (feature, region), e.g. of ``regions.site_regions``; a site may be in several regions, repeated rows
    count once. Sites without a test (too few cells, no spread) count for the means only; a region without any tested
    site has NULL p values, and ranks last by p. Cells that a site lacks count as residuals of 0.
    """
    pair, cells, cols = _pair(long, group, first, second, covariates, levels, value)
    inside = materialise(membership.select(feature, region).dropna().distinct(), "membership")
    fits = materialise(_tests(_fits(cells, cols, feature), len(cols)), "fits")
    tested = fits.where(F.col("p_value").isNotNull() & ~F.isnan("p_value") & (F.col("rss") > 1e-12 * F.col("w_vv"))
                        & (F.col("w_vv") > 1e-13 * F.col("svv")))  # less is what rounding leaves of no spread
    places = materialise(row_index(cells.select(sample).distinct(), [sample], out="_at"), "samples")
    fitted = plus([(F.col(c) - F.col("_xbar")[i]) * F.col("beta")[i] for i, c in enumerate(cols)])
    whole = attach(cells.dropna(subset=["_v", *cols]), tested.select(feature, "_ybar", "_xbar", "beta", "rss"), feature, "inner")
    residuals = attach(whole, places, sample, "inner").select(
        feature, (F.col("_at") - 1).cast("int").alias("at"), ((F.col("_v") - F.col("_ybar") - fitted) / F.sqrt("rss")).alias("z"))
    vectors = residuals.groupBy(feature).agg(F.collect_list(F.struct("at", "z")).alias("c")).select(
        feature, F.col("c.at").alias("at"), F.col("c.z").alias("z"))
    used = attach(inside, tested.select(feature), feature, "left_semi")
    correlation = region_correlation(vectors, used, places.count(), feature, region, limit)
    p = combined_p(tested, correlation, used, feature, region)
    means = region_means(group_means(pair, F.col(group) == first, feature, value), inside, feature, region)
    table = materialise(attach(means, p, region), "regions")
    return worst_rank(adjusted_p(table, "comb_p", "comb_p_adj"), "mean_diff", "quot_log2", "comb_p")
