"""Linear models, analysis of variance and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators.stats import anova as av
from cohortloom.operators.stats import ols as ls
from cohortloom.operators.stats import tukey as tk
from cohortloom.queries.registry import Tables, query, r


@query("""
WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
     a AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
     s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - grand) ** 2) AS ssb, sum(n * v) AS ssw FROM g, a)
SELECT 'o_orderpriority' AS term, CAST(k - 1 AS BIGINT) AS df, round(ssb / 1e6, 4) AS sumsq, round(ssb / (k - 1) / 1e6, 4) AS meansq,
       round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic FROM s
UNION ALL
SELECT 'Residuals', CAST(n - k AS BIGINT), round(ssw / 1e6, 4), round(ssw / (n - k) / 1e6, 4), NULL FROM s
""")
def anova_oneway(t: Tables):
    out = av.anova_oneway(t.orders, "o_totalprice", "o_orderpriority")
    return out.select("term", "df", r(F.col("sumsq") / 1e6, 4).alias("sumsq"), r(F.col("meansq") / 1e6, 4).alias("meansq"),
                      r("statistic").alias("statistic"))


# Each term's part is that of its column after the earlier terms are swept out of it and of the response.
@query("""
WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS y, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s, l_quantity AS q FROM lineitem),
     w AS (SELECT y - avg(y) OVER () AS y0, avg(y) OVER (PARTITION BY g) - avg(y) OVER () AS yg, y - avg(y) OVER (PARTITION BY g) AS y1,
                  s - avg(s) OVER (PARTITION BY g) AS s1, q - avg(q) OVER (PARTITION BY g) AS q1 FROM d),
     b AS (SELECT sum(s1 * q1) / sum(s1 * s1) AS bq, sum(s1 * y1) / sum(s1 * s1) AS bs FROM w),
     p AS (SELECT count(*) AS n, sum(y0 * y0) AS total, sum(yg * yg) AS ss1, sum(s1 * y1) ** 2 / sum(s1 * s1) AS ss2,
                  sum((q1 - bq * s1) * y1) ** 2 / sum((q1 - bq * s1) ** 2) AS ss3 FROM w, b),
     r AS (SELECT *, (total - ss1 - ss2 - ss3) / (n - 5) AS msr FROM p)
SELECT 'l_returnflag' AS term, CAST(2 AS BIGINT) AS df, round(ss1 / 1e6, 3) AS sumsq, round(ss1 / 2 / msr, 4) AS statistic FROM r
UNION ALL SELECT 'l_linestatus', 1, round(ss2 / 1e6, 3), round(ss2 / msr, 4) FROM r
UNION ALL SELECT 'l_quantity', 1, round(ss3 / 1e6, 3), round(ss3 / msr, 4) FROM r
UNION ALL SELECT 'Residuals', n - 5, round(msr * (n - 5) / 1e6, 3), NULL FROM r
""")
def anova_sequential(t: Tables):
    out = av.anova(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_quantity"])
    return out.select("term", "df", r(F.col("sumsq") / 1e6, 3).alias("sumsq"), r("statistic", 4).alias("statistic"))


@query()
def anova_sequential_tails(t: Tables):
    """The whole table with tail probabilities, which SQL has no function for."""
    return av.anova(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_quantity"])


@query("""
WITH c AS (SELECT list_position(['F','O','P'], o_orderstatus) AS y, o_orderpriority AS g FROM orders),
     g AS (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM c GROUP BY 1),
     a AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
     s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - grand) ** 2) AS ssb, sum(n * v) AS ssw FROM g, a)
SELECT 'o_orderpriority' AS term, CAST(k - 1 AS BIGINT) AS df, round(ssb, 6) AS sumsq,
       round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic FROM s
UNION ALL
SELECT 'Residuals', CAST(n - k AS BIGINT), round(ssw, 6), NULL FROM s
""")
def anova_coded(t: Tables):
    out = av.anova_coded(t.orders, "o_orderstatus", ["o_orderpriority"])
    return out.select("term", "df", r("sumsq").alias("sumsq"), r("statistic").alias("statistic"))


@query()
def tukey_hsd(t: Tables):
    return tk.tukey_hsd(t.orders, "o_totalprice", "o_orderpriority")


@query("""
WITH g AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT b.g || '-' || a.g AS comparison, round(b.m - a.m, 4) AS estimate FROM g a JOIN g b ON a.g < b.g
""")
def tukey_estimates(t: Tables):
    return tk.tukey_hsd(t.orders, "o_totalprice", "o_orderpriority").select("comparison", r("estimate", 4).alias("estimate"))


@query("""
SELECT '(Intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS estimate FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem
""")
def ols(t: Tables):
    return ls.ols(t.lineitem, "l_extendedprice", ["l_quantity"]).select("term", r("estimate", 4).alias("estimate"))
