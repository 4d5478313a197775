"""Matrix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators.matrix import bmiq as bq
from cohortloom.operators.matrix import combat as cb
from cohortloom.operators.matrix import core, covariates, differential, filters, normalise
from cohortloom.operators.matrix import reduce as red
from cohortloom.operators.matrix import regions as rg
from cohortloom.operators.matrix import tree
from cohortloom.operators.ordering import rank_of
from cohortloom.session import materialise
from cohortloom.queries.registry import (EMBEDDING_SQL, PROBE_SQL, REGION_SQL, Tables, embedding_matrix, probe_matrix,
                                         query, r, regions, sites)

# Mean detections are multiples of 0.01 / n; the cut lies between them, as a mean that equals it would
# fall on either side by the order in which it was summed.
DETECTION_CUT = 0.0703


@query("SELECT feature_id, sample_id, value FROM (SELECT l_partkey AS feature_id, l_suppkey AS sample_id, l_extendedprice AS value FROM lineitem) "
       "WHERE sample_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def matrix_subset_samples(t: Tables):
    long = t.lineitem.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sample_id"),
                             F.col("l_extendedprice").alias("value"))
    return core.subset_samples(long, t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("sample_id")))


@query("SELECT l_partkey AS feature_id, l_suppkey AS sample_id, l_extendedprice AS value FROM lineitem "
       "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def matrix_subset_features(t: Tables):
    long = t.lineitem.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sample_id"),
                             F.col("l_extendedprice").alias("value"))
    return core.subset_features(long, t.part.where("p_size > 25").select(F.col("p_partkey").alias("feature_id")))


@query("""
SELECT CASE WHEN p_size > 10 THEN p_brand END AS feature_id, l_suppkey AS sample_id, l_extendedprice AS value
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
""")
def map_ids(t: Tables):
    long = t.lineitem.select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("sample_id"),
                             F.col("l_extendedprice").alias("value"))
    names = t.part.where("p_size > 10").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("symbol"))
    return core.map_ids(long, names, "feature_id", "symbol")


@query("SELECT l_partkey AS feature_id, l_suppkey AS sample_id, round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2")
def collapse_dups(t: Tables):
    out = core.collapse_dups(t.lineitem.select(F.col("l_partkey").alias("feature_id"),
                                               F.col("l_suppkey").alias("sample_id"), F.col("l_extendedprice").alias("value")))
    return out.select("feature_id", "sample_id", r("value").alias("value"))


@query(f"""
WITH {EMBEDDING_SQL}
SELECT sample_id, max(value) FILTER (WHERE feature_id = 3) AS probe_a, max(value) FILTER (WHERE feature_id = 7) AS probe_b, any_value(label) AS grp
FROM matrix JOIN embeddings ON vec_id = sample_id GROUP BY 1
""")
def feature_frame(t: Tables):
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("grp"))
    return core.feature_frame(embedding_matrix(t), {"probe_a": 3, "probe_b": 7}, pheno)


@query("""
SELECT c_custkey, CAST(1.0 AS DOUBLE) AS x1, c_acctbal AS x2, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x3,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x4, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x5,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x6 FROM customer
""")
def design_matrix(t: Tables):
    rows, names = core.design(t.customer, ["c_acctbal", "c_mktsegment"])
    return rows.select("c_custkey", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(len(names))])


_VST_SQL = f"""
WITH {PROBE_SQL}, fit AS (
  SELECT sample_id, regr_slope(stdev, value) AS c1, regr_intercept(stdev, value) AS c2,
         avg(stdev * stdev) FILTER (WHERE detection > 0.0703) AS c3 FROM probes GROUP BY 1)
"""


@query(_VST_SQL + "SELECT sample_id, round(c1, 6) AS c1, round(c2, 4) AS c2, round(c3 / 1e6, 4) AS c3 FROM fit")
def vst_regression(t: Tables):
    fit = normalise.vst_regression(probe_matrix(t), DETECTION_CUT)
    return fit.select("sample_id", r("c1").alias("c1"), r("c2", 4).alias("c2"), r(F.col("c3") / 1e6, 4).alias("c3"))


@query(_VST_SQL + "SELECT feature_id, sample_id, round(asinh((c2 + c1 * value) / sqrt(c3)) / c1, 4) AS value FROM probes JOIN fit USING (sample_id)")
def vst(t: Tables):
    return normalise.vst(probe_matrix(t), DETECTION_CUT).select("feature_id", "sample_id", r("value", 4).alias("value"))


@query(f"""
WITH {EMBEDDING_SQL}, ranked AS (
  SELECT feature_id, sample_id, value, row_number() OVER (PARTITION BY sample_id ORDER BY value, feature_id) AS rk FROM matrix),
target AS (SELECT rk, avg(value) AS target FROM ranked GROUP BY 1)
SELECT feature_id, sample_id, round(avg(target) OVER (PARTITION BY sample_id, value), 6) AS value FROM ranked JOIN target USING (rk)
""")
def quantile_norm(t: Tables):
    out = normalise.quantile_normalise(embedding_matrix(t).select("feature_id", "sample_id", "value"))
    return out.select("feature_id", "sample_id", r("value").alias("value"))


@query()
def rsn(t: Tables):
    return normalise.rsn(embedding_matrix(t).select("feature_id", "sample_id", "value"))


@query(f"""
WITH {EMBEDDING_SQL}, s AS (
  SELECT feature_id, regr_slope(value, age) AS b, avg(age) AS m FROM matrix GROUP BY 1)
SELECT feature_id, sample_id, round(value - b * (age - m), 6) AS value FROM matrix JOIN s USING (feature_id)
""")
def ols_residualise(t: Tables):
    out = covariates.ols_residualise(embedding_matrix(t), ["age"])
    return out.select("feature_id", "sample_id", r("value").alias("value"))


@query()
def eb_remove_covariates(t: Tables):
    return covariates.eb_remove_covariates(embedding_matrix(t), ["age", "sex"], {"sex": ["F", "M"]}).select("feature_id", "sample_id", "value")


@query(f"""
WITH {EMBEDDING_SQL}, b AS (SELECT feature_id, batch, avg(value) AS bm, count(*) AS n, var_pop(value) * count(*) AS ss FROM matrix GROUP BY 1, 2),
f AS (SELECT feature_id, sum(bm * n) / sum(n) AS alpha, sqrt(sum(ss) / sum(n)) AS sigma FROM b GROUP BY 1),
z AS (SELECT feature_id, sample_id, batch, (value - alpha) / sigma AS z FROM matrix JOIN f USING (feature_id))
SELECT feature_id, sample_id, round(z, 5) AS z, round(avg(z) OVER w, 5) AS gamma_hat, round(var_samp(z) OVER w, 5) AS delta_hat
FROM z WINDOW w AS (PARTITION BY feature_id, batch)
""")
def combat_standardise(t: Tables):
    out = cb.combat_standardise(embedding_matrix(t))
    return out.select("feature_id", "sample_id", *[r(c, 5).alias(c) for c in ("z", "gamma_hat", "delta_hat")])


@query(f"""
WITH RECURSIVE {EMBEDDING_SQL}, b AS (SELECT feature_id, batch, avg(value) AS bm, count(*) AS n, var_pop(value) * count(*) AS ss FROM matrix GROUP BY 1, 2),
f AS (SELECT feature_id, sum(bm * n) / sum(n) AS alpha, sqrt(sum(ss) / sum(n)) AS sigma FROM b GROUP BY 1),
z AS (SELECT feature_id, sample_id, batch, alpha, sigma, (value - alpha) / sigma AS z FROM matrix JOIN f USING (feature_id)),
s AS (SELECT feature_id, batch, count(*) AS n, sum(z) AS s1, sum(z * z) AS s2, avg(z) AS gh, var_samp(z) AS dh FROM z GROUP BY 1, 2),
m AS (SELECT batch, avg(gh) AS gbar, var_samp(gh) AS t2, avg(dh) AS m, var_samp(dh) AS v FROM s GROUP BY 1),
it AS (
  SELECT feature_id, batch, n, s1, s2, gh, gbar, t2, (2 * v + m * m) / v AS a, (m * v + m * m * m) / v AS bb, gh AS g, dh AS d, 0 AS i
  FROM s JOIN m USING (batch)
  UNION ALL
  SELECT feature_id, batch, n, s1, s2, gh, gbar, t2, a, bb, gn, (0.5 * (s2 - 2 * gn * s1 + n * gn * gn) + bb) / (n / 2.0 + a - 1), i + 1
  FROM (SELECT *, (t2 * n * gh + d * gbar) / (t2 * n + d) AS gn FROM it WHERE i < 60))
SELECT z.feature_id, z.sample_id, round((z.z - g) / sqrt(d) * sigma + alpha, 6) AS value
FROM z JOIN it ON it.feature_id = z.feature_id AND it.batch = z.batch AND it.i = 60
""")
def combat_without_covariates(t: Tables):
    out = cb.combat(embedding_matrix(t), "batch", conv=1e-13)
    return out.select("feature_id", "sample_id", r("value").alias("value"))


@query()
def combat(t: Tables):
    return cb.combat(embedding_matrix(t), "batch", ["age", "sex"], {"sex": ["F", "M"]}).select("feature_id", "sample_id", "value")


@query(f"""
WITH {PROBE_SQL}
SELECT sample_id, round(avg(CASE WHEN value > 50000 THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
  round(avg(CASE WHEN detection > 0.0703 THEN 1.0 ELSE 0.0 END), 6) AS failed_rate,
  round(quantile_cont(CASE WHEN value <= 50000 THEN value END, 0.25), 6) AS q1, round(quantile_cont(CASE WHEN value <= 50000 THEN value END, 0.5), 6) AS median,
  round(quantile_cont(CASE WHEN value <= 50000 THEN value END, 0.75), 6) AS q3 FROM probes GROUP BY 1
""")
def sample_qc(t: Tables):
    m = probe_matrix(t).withColumn("value", F.when(F.col("value") <= 50000, F.col("value")))
    out = filters.sample_qc(m, DETECTION_CUT)
    return out.select("sample_id", r("missing_rate").alias("missing_rate"), r("failed_rate").alias("failed_rate"),
                      *[r(c).alias(c) for c in ("q1", "median", "q3")])


def _annotated(t: Tables):
    long = t.lineitem.select(F.col("l_partkey").alias("feature_id"), F.col("l_orderkey").alias("sample_id"),
                             F.col("l_extendedprice").alias("value"))
    notes = t.part.select(F.col("p_partkey").alias("feature_id"), F.when(F.col("p_type") == "ECONOMY", "CH").otherwise("CG").alias("context"),
                          (F.col("p_size") % 5).alias("snp_count"), F.when(F.col("p_brand") == "Brand#2", "X").when(
                              F.col("p_brand") == "Brand#17", "chrY").otherwise("1").alias("chrom"))
    return long, notes


_CELLS = "SELECT l_partkey AS feature_id, l_orderkey AS sample_id, l_extendedprice AS value FROM lineitem JOIN part ON p_partkey = l_partkey WHERE "


@query(_CELLS + "p_type <> 'ECONOMY'")
def filter_context(t: Tables):
    return filters.filter_context(*_annotated(t))


@query(_CELLS + "p_size % 5 = 0")
def filter_snp(t: Tables):
    return filters.filter_snp(*_annotated(t))


@query(_CELLS + "p_brand NOT IN ('Brand#2', 'Brand#17')")
def filter_sex_chrom(t: Tables):
    return filters.filter_sex_chrom(*_annotated(t))


@query()
def greedycut(t: Tables):
    return filters.greedycut(probe_matrix(t), DETECTION_CUT)


@query(f"""
WITH {PROBE_SQL}, m AS (SELECT feature_id, sample_id, nullif(value, (SELECT max(value) FROM probes)) AS value FROM probes),
k AS (SELECT feature_id FROM m GROUP BY 1 HAVING count(value) = count(*) AND count(value) = (SELECT count(DISTINCT sample_id) FROM m))
SELECT feature_id, sample_id, round(value, 6) AS value FROM m WHERE feature_id IN (FROM k)
""")
def filter_na_sites(t: Tables):
    m = probe_matrix(t)
    blanked = m.withColumn("value", F.nullif("value", m.agg(F.max("value")).scalar()))
    return filters.filter_na(blanked).select("feature_id", "sample_id", r("value").alias("value"))


@query(f"""
WITH {EMBEDDING_SQL}
SELECT feature_id, sample_id, value FROM matrix
WHERE feature_id IN (SELECT feature_id FROM matrix GROUP BY 1 HAVING stddev_samp(value) >= 0.125)
""")
def filter_low_sd(t: Tables):
    return filters.filter_low_sd(embedding_matrix(t), 0.125).select("feature_id", "sample_id", "value")


@query()
def noob(t: Tables):
    cells = t.lineitem.select(F.col("l_partkey").alias("feature_id"), F.col("l_linenumber").alias("sample_id"),
                              F.col("l_linestatus").alias("channel"), F.col("l_extendedprice").alias("value"), "l_returnflag")
    return normalise.noob(cells.where("l_returnflag <> 'A'").drop("l_returnflag"),
                          cells.where("l_returnflag = 'A'").drop("l_returnflag"))


@query()
def bmiq(t: Tables):
    m = embedding_matrix(t).select("feature_id", "sample_id", (1 / (1 + F.exp(-12 * F.col("value")))).alias("value"),
                                   F.when(F.col("feature_id") % 2 == 0, "I").otherwise("II").alias("design"))
    return bq.bmiq(m)


@query(f"""
WITH {REGION_SQL}
SELECT region_id, user_id AS sample_id, round(avg(value), 6) AS value, count(value) AS n_sites
FROM events JOIN regions ON chrom = event_type AND event_id BETWEEN region_start AND region_end GROUP BY 1, 2
""")
def region_mean(t: Tables):
    s = sites(t).withColumnRenamed("site_id", "feature_id")
    out = rg.region_mean(s.select("feature_id", "sample_id", "value"), s.select("feature_id", "chrom", "pos"), regions(t))
    return out.select("region_id", "sample_id", r("value").alias("value"), "n_sites")


@query()
def pca(t: Tables):
    return red.pca(embedding_matrix(t), 3)


@query(f"""
WITH {EMBEDDING_SQL}, c AS (SELECT sample_id, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM matrix)
SELECT sample_id, round(sum(v * v), 6) AS size FROM c GROUP BY 1
""")
def pca_sizes(t: Tables):
    """All components of a sample together keep its distance from the mean, whatever their signs."""
    scores = red.pca(embedding_matrix(t), 64)
    size = sum((F.col(c) * F.col(c) for c in scores.columns[2:]), F.col("pc1") * F.col("pc1"))
    return scores.select("sample_id", r(size).alias("size"))


@query(f"""
WITH {EMBEDDING_SQL}, o AS (SELECT feature_id, value FROM matrix WHERE sample_id = (SELECT min(sample_id) FROM matrix))
SELECT sample_id, round(sqrt(sum((m.value - o.value) ** 2)), 6) AS distance FROM matrix m JOIN o USING (feature_id) GROUP BY 1
""")
def mds(t: Tables):
    """Scaling to all dimensions keeps distances, here those to the first sample."""
    scaled = red.mds(embedding_matrix(t), 64)
    first = scaled.orderBy("sample_id").first()
    away = sum(((F.col(c) - F.lit(first[c])) ** 2 for c in scaled.columns[2:]), (F.col("dim1") - F.lit(first["dim1"])) ** 2)
    return scaled.select("sample_id", r(F.sqrt(away)).alias("distance"))


@query(f"WITH {EMBEDDING_SQL} SELECT feature_id, sample_id, value FROM matrix")
def stored_matrix(t: Tables):
    return materialise(embedding_matrix(t).select("feature_id", "sample_id", "value"), "matrix")


@query()
def pc_association(t: Tables):
    m = embedding_matrix(t)
    return red.pc_association(red.pca(m, 2), m.select("sample_id", "batch", "age").distinct(), ["batch", "age"])


@query()
def cluster_samples(t: Tables):
    return red.cluster_samples(embedding_matrix(t), 5)


@query()
def sample_tree(t: Tables):
    return tree.sample_tree(embedding_matrix(t))


@query(f"""
WITH {EMBEDDING_SQL}
SELECT a.sample_id, round(sqrt(min(d)), 6) AS nearest FROM (
  SELECT x.vec_id AS sample_id, list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) a GROUP BY 1
""")
def tree_nearest(t: Tables):
    """The lowest merge of every sample joins it with its nearest one."""
    merges = tree.sample_tree(embedding_matrix(t))
    ends = merges.select(F.explode(F.array("sample_a", "sample_b")).alias("sample_id"), "height")
    return ends.groupBy("sample_id").agg(r(F.min("height")).alias("nearest"))


@query()
def diff_features(t: Tables):
    return differential.diff_features(embedding_matrix(t), "batch", "0", "1", ["age"])


@query(f"""
WITH {EMBEDDING_SQL}
SELECT feature_id, round(avg(value) FILTER (WHERE batch = '0'), 6) AS mean_g1, round(avg(value) FILTER (WHERE batch = '1'), 6) AS mean_g2,
  round(avg(value) FILTER (WHERE batch = '0') - avg(value) FILTER (WHERE batch = '1'), 6) AS mean_diff FROM matrix
WHERE batch IN ('0', '1') GROUP BY 1
""")
def diff_group_means(t: Tables):
    m = embedding_matrix(t).where(F.col("batch").isin("0", "1"))
    return red.group_means(m, F.col("batch") == "0").select("feature_id", *[r(c).alias(c) for c in ("mean_g1", "mean_g2", "mean_diff")])


def _site_groups(t: Tables):
    """Parts as sites on a few chromosomes, line numbers as samples of two groups, and regions of 100 positions that
    overlap by 40."""
    long = probe_matrix(t).select("feature_id", "sample_id", "value", F.when(F.col("sample_id") <= 3, "a").otherwise("b").alias("grp"),
                                  (F.col("sample_id") % 2).cast("double").alias("age"))
    notes = t.part.select(F.col("p_partkey").alias("feature_id"), F.concat(F.lit("c"), F.col("p_size") % 3).alias("chrom"),
                          F.col("p_partkey").alias("pos"))
    windows = notes.select("chrom", F.floor(F.col("pos") / 60).alias("k")).distinct().select(
        "chrom", F.concat_ws(":", "chrom", "k").alias("region_id"), (F.col("k") * 60).alias("start"), (F.col("k") * 60 + 99).alias("end"))
    return long, rg.site_regions(notes, windows)


@query(f"""
WITH {PROBE_SQL}, w AS (SELECT DISTINCT 'c' || (p_size % 3) AS chrom, p_partkey // 60 AS k FROM part),
m AS (SELECT p_partkey AS feature_id, w.chrom || ':' || k AS region_id FROM part JOIN w ON w.chrom = 'c' || (p_size % 3) AND p_partkey BETWEEN 60 * k AND 60 * k + 99),
f AS (SELECT feature_id, avg(value) FILTER (sample_id <= 3) AS g1, avg(value) FILTER (sample_id > 3) AS g2 FROM probes GROUP BY 1)
SELECT region_id, count(*) AS n_sites, round(avg(g1), 4) AS mean_g1, round(avg(g2), 4) AS mean_g2, round(avg(g1 - g2), 4) AS mean_diff,
  round(avg(log2((g1 + 0.01) / (g2 + 0.01))), 6) AS quot_log2, rank() OVER (ORDER BY round(abs(avg(g1 - g2)), 4) DESC) AS diff_rank
FROM m JOIN f USING (feature_id) GROUP BY 1
""")
def diff_region_means(t: Tables):
    long, membership = _site_groups(t)
    means = differential.region_means(red.group_means(long, F.col("grp") == "a"), membership)
    rounded = means.select("region_id", "n_sites", *[r(c, 4).alias(c) for c in ("mean_g1", "mean_g2", "mean_diff")], r("quot_log2").alias("quot_log2"))
    return rank_of(rounded.withColumn("_d", F.abs("mean_diff")), "_d", "diff_rank", descending=True).drop("_d")


@query()
def diff_regions(t: Tables):
    long, membership = _site_groups(t)
    return differential.diff_regions(long, membership, "grp", "a", "b", ["age"])


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size < 5 THEN p_brand || ';' || p_type ELSE p_type || '-' || p_size END AS symbol FROM part)
SELECT p_partkey, regexp_replace(symbol, '-.*$', '') AS symbol FROM a WHERE symbol IS NOT NULL AND NOT contains(symbol, ';')
""")
def clean_annotation(t: Tables):
    symbol = F.when(F.col("p_size") > 40, None).when(F.col("p_size") < 5, F.concat_ws(";", "p_brand", "p_type")).otherwise(
        F.concat_ws("-", "p_type", F.col("p_size").cast("string")))
    return rg.clean_annotation(t.part.select("p_partkey", symbol.alias("symbol")))
