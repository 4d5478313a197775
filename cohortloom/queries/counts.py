"""Counts, strict aggregates and group reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.strings import recode
from cohortloom.operators import dedup, joins, summaries
from cohortloom.queries.registry import Tables, query, r

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUSES = ["F", "O", "P"]


@query("""
WITH patient AS (
  SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_totalprice < 50000) = 0 THEN max(o_totalprice) END AS age
  FROM orders GROUP BY o_custkey)
SELECT n_name AS grp,
  count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS "AUTOMOBILE",
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS "BUILDING",
  count(*) FILTER (WHERE c_mktsegment = 'FURNITURE') AS "FURNITURE",
  count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS "HOUSEHOLD",
  count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS "MACHINERY",
  count(*) FILTER (WHERE c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')) AS "Total",
  round(avg(age), 4) AS mean_age, count(*) FILTER (WHERE age IS NULL) AS unknown_age
FROM patient JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY n_name HAVING count(age) > 0
""")
def group_summary(t: Tables):
    draws = t.orders.select("o_custkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("age"))
    # One strict maximum per patient is also the one row per patient.
    patient = summaries.aggregate_strict(draws, "o_custkey", "age", "max", "age")
    people = (patient.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
              .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")))
    out = summaries.group_summary(people, "n_name", "c_mktsegment", "age", SEGMENTS)
    return out.select(F.col("n_name").alias("grp"), *SEGMENTS, "Total", r("mean_value", 4).alias("mean_age"),
                      F.col("n_unknown").alias("unknown_age"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def count_per_key(t: Tables):
    return summaries.count_per_key(t.orders, "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_count(t: Tables):
    return summaries.count_per_key(t.orders, "o_custkey").where("n > 12")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 13)
""")
def rows_of_frequent(t: Tables):
    return summaries.rows_of_frequent(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 13)


@query("""
WITH d AS (SELECT user_id, nullif(event_type, 'error') AS v FROM events)
SELECT user_id, count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS n_distinct,
       count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1 AS single
FROM d GROUP BY user_id
""")
def distinct_per_key(t: Tables):
    src = t.events.select("user_id", F.nullif("event_type", F.lit("error")).alias("v"))
    return summaries.distinct_per_key(src, "user_id", "v")


@query("""
SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_distinct,
       CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS o_orderstatus
FROM orders GROUP BY 1
""")
def single_vs_multi(t: Tables):
    return summaries.resolve_single(t.orders, "o_custkey", "o_orderstatus")


@query("""
WITH p AS (SELECT o_custkey, count(*) AS n_a FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
     f AS (SELECT o_custkey, count(*) AS n_b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, n_a, n_b, n_a = n_b AS agree FROM p JOIN f USING (o_custkey)
""")
def counts_agree(t: Tables):
    o = t.orders
    return summaries.counts_agree(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "o_custkey")


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
  count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P",
  count(*) FILTER (WHERE o_orderstatus IN ('F','O','P')) AS "Total"
FROM orders GROUP BY 1
""")
def crosstab_total(t: Tables):
    return summaries.crosstab_total(t.orders, "o_orderpriority", "o_orderstatus", STATUSES)


@query("""
SELECT event_type, round(avg(nullif(value, 6.55)), 6) AS mean_value FROM events
WHERE value <> 6.55 GROUP BY 1
""")
def mean_per_group(t: Tables):
    src = t.events.select("event_type", F.nullif("value", F.lit(6.55)).alias("value"))
    out = summaries.aggregate_strict(src, "event_type", "value", "mean", "mean_value", na_rm=True)
    return out.select("event_type", r("mean_value").alias("mean_value"))


@query("""
SELECT o_custkey, min(o_totalprice) AS min_value FROM orders WHERE o_totalprice >= 50000 GROUP BY 1
""")
def min_per_key(t: Tables):
    valid = t.orders.select("o_custkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("v"))
    return summaries.aggregate_strict(valid, "o_custkey", "v", "min", "min_value", na_rm=True)


@query("""
SELECT o_custkey, CASE WHEN bool_or(o_totalprice < 50000) THEN NULL ELSE max(o_totalprice) END AS max_value
FROM orders GROUP BY 1
""")
def max_per_key_strict(t: Tables):
    valid = t.orders.select("o_custkey", F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("v"))
    return summaries.aggregate_strict(valid, "o_custkey", "v", "max", "max_value")


@query("""
SELECT event_type, count(*) FILTER (WHERE value < 5) AS n_missing FROM events GROUP BY 1
""")
def null_count(t: Tables):
    src = t.events.select("event_type", F.when(F.col("value") >= 5, F.col("value")).alias("v"))
    return summaries.null_count(src, "event_type", "v")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(t: Tables):
    return summaries.distinct_values(t.part, "p_brand", "p_type")


@query("""
WITH multi AS (SELECT o_custkey, 'Mixed' AS o_orderstatus FROM orders
               GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3)
SELECT o_orderkey, o_custkey, coalesce(m.o_orderstatus, o.o_orderstatus) AS o_orderstatus
FROM orders o LEFT JOIN multi m USING (o_custkey)
""")
def override_label(t: Tables):
    given = (summaries.resolve_single(t.orders, "o_custkey", "o_orderstatus").where("n_distinct = 3")
             .select("o_custkey", F.lit("Mixed").alias("o_orderstatus")))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return summaries.override_label(rows, given, "o_custkey", "o_orderstatus")


@query("""
SELECT o_custkey, round(abs(list_reduce(list(o_totalprice ORDER BY o_orderkey), lambda x, y: x - y)), 2) AS difference
FROM orders GROUP BY 1
""")
def abs_difference(t: Tables):
    out = summaries.fold_difference(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])
    return out.select("o_custkey", r("difference", 2).alias("difference"))


@query("""
WITH s AS (SELECT o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS p,
             lag(CAST(left(o_orderpriority, 1) AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q
           FROM orders)
SELECT o_custkey, bool_and(q IS NULL OR p >= q) AS monotone FROM s GROUP BY 1
""")
def is_monotone(t: Tables):
    src = t.orders.select("o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int").alias("p"), "o_orderdate",
                          "o_orderkey")
    return summaries.is_monotone(src, "o_custkey", "p", ["o_orderdate", "o_orderkey"])


@query("""
WITH s AS (SELECT l_discount AS p, l_tax - 0.04 AS effect FROM lineitem), th(threshold) AS (VALUES (0.01), (0.03), (0.07))
SELECT CAST(threshold AS DOUBLE) AS threshold, 'positive' AS direction,
       count(*) FILTER (WHERE p < threshold AND effect > 0) AS n FROM s, th GROUP BY 1
UNION ALL
SELECT CAST(threshold AS DOUBLE), 'negative', -count(*) FILTER (WHERE p < threshold AND effect < 0) FROM s, th GROUP BY 1
""")
def threshold_counts(t: Tables):
    src = t.lineitem.select(F.col("l_discount").alias("p"), (F.col("l_tax") - 0.04).alias("effect"))
    return summaries.threshold_counts(src, "p", "effect", [0.01, 0.03, 0.07])


@query("""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med,
             quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderpriority, round(max(q1), 4) AS q1, round(max(med), 4) AS median, round(max(q3), 4) AS q3,
  min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS whisker_low,
  max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS n_outliers
FROM orders JOIN q USING (o_orderpriority) GROUP BY 1
""")
def box_stats(t: Tables):
    out = summaries.box_stats(t.orders, "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", *[r(c, 4).alias(c) for c in ("q1", "median", "q3")], "whisker_low",
                      "whisker_high", "n_outliers")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def bar_counts(t: Tables):
    return summaries.bar_counts(t.documents, "lang", "source")


@query("""
WITH s AS (SELECT o_custkey, c_mktsegment, o_orderpriority,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
           FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderpriority AS gene, c_mktsegment AS diagnosis, count(*) AS n FROM s WHERE rn = 1 GROUP BY 1, 2
""")
def mutation_counts(t: Tables):
    genes = t.orders.select(F.col("o_custkey").alias("person"), "o_orderpriority", "o_orderdate", "o_orderkey")
    people = t.customer.select(F.col("c_custkey").alias("person"), "c_mktsegment")
    first = dedup.first_per_key(joins.natural_join(genes, people), "person", ["o_orderdate", "o_orderkey"])
    return summaries.bar_counts(first.select(F.col("o_orderpriority").alias("gene"),
                                             F.col("c_mktsegment").alias("diagnosis")), "gene", "diagnosis")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS position FROM d
""")
def ungroup_values(t: Tables):
    return summaries.ungroup_values(t.orders, "o_custkey", "o_orderpriority")


@query("""
SELECT o_custkey, CAST(0 AS BIGINT) AS chunk, count(*) AS n_rows, arg_min(o_totalprice, o_orderkey) AS first_value,
       arg_max(o_totalprice, o_orderkey) AS last_value
FROM orders GROUP BY 1
""")
def nest_per_key(t: Tables):
    out = summaries.nest_per_key(t.orders, "o_custkey", ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    return out.select("o_custkey", "chunk", F.size("rows").cast("long").alias("n_rows"),
                      F.col("rows")[0]["o_totalprice"].alias("first_value"),
                      F.element_at("rows", -1)["o_totalprice"].alias("last_value"))


@query("SELECT CAST(0 AS BIGINT) AS chunk, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS collapsed FROM part")
def collapse_values(t: Tables):
    return summaries.collapse_values(t.part, "p_brand")


@query("""
WITH u AS (SELECT doc_id, replace(upper(lang), 'FR', 'FRA') AS lang, source FROM documents)
SELECT lang, count(*) AS n FROM u GROUP BY 1
""")
def recode_labels(t: Tables):
    docs = t.documents.select(recode(F.col("lang"), {"FR": "FRA"}).alias("lang"))
    return summaries.count_per_key(docs, "lang")
