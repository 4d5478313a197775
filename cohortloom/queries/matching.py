"""Joins and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import dedup, joins
from cohortloom.queries.registry import REGION_SQL, Tables, query, regions, sites


@query("""
SELECT c.c_custkey AS code, c.c_name AS name_x, s.s_name AS name_y, c.c_acctbal AS balance_x, s.s_acctbal AS balance_y
FROM customer c JOIN supplier s ON c.c_custkey = s.s_suppkey
""")
def join_inner(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return joins.join_on(a, b, "code")


@query("SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_natural(t: Tables):
    return joins.natural_join(t.documents.select("doc_id", "lang", "n_chars"), t.labels)


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_left(t: Tables):
    return joins.natural_join(t.documents.select("doc_id", "lang"), t.labels, "left")


@query("""
SELECT o.o_orderkey AS orderkey, o.o_custkey AS custkey, c_nationkey AS nationkey, n_regionkey AS regionkey, r_name
FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
""")
def join_many(t: Tables):
    return joins.join_many([
        t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")),
        t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")),
        t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey")),
        t.region.select(F.col("r_regionkey").alias("regionkey"), "r_name")]).select(
            "orderkey", "custkey", "nationkey", "regionkey", "r_name")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
""")
def join_semi(t: Tables):
    return joins.keep_in(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 450000"),
                         "c_custkey", "o_custkey")


@query("""
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
""")
def join_anti(t: Tables):
    return joins.drop_in(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 450000"),
                         key="c_custkey", other_key="o_custkey")


@query("""
SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 20000)
""")
def join_anti2(t: Tables):
    o = t.orders
    return joins.drop_in(t.customer.select("c_custkey"), o.where("o_totalprice > 450000"),
                         o.where("o_totalprice < 20000"), key="c_custkey", other_key="o_custkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE CAST(s_suppkey AS VARCHAR) IN (SELECT CAST(p_size AS VARCHAR) FROM part)")
def match_exact(t: Tables):
    a = t.supplier.select("s_suppkey", "s_name", F.col("s_suppkey").cast("string").alias("code"))
    b = t.part.select(F.col("p_size").cast("string").alias("size"))
    return joins.match_substring(a, b, "code", "size", exact=True).drop("code")


@query("""
SELECT c_custkey FROM customer c WHERE EXISTS (
  SELECT 1 FROM supplier WHERE contains(CAST(c.c_custkey AS VARCHAR), CAST(s_suppkey AS VARCHAR)))
""")
def match_substring(t: Tables):
    a = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    b = t.supplier.select(F.col("s_suppkey").cast("string").alias("key"))
    return joins.match_substring(a, b, "code", "key", exact=False).select("c_custkey")


@query("""
SELECT c_custkey, p AS first_position, p IS NOT NULL AS found
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def lookup_first(t: Tables):
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.lookup_first(t.customer.select("c_custkey"), b, "c_custkey", "o_orderkey").withColumn(
        "found", F.col("first_position").isNotNull())


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 9 END AS quality FROM documents)
SELECT doc_id, coalesce(d.quality, l.quality) AS quality FROM d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(d.quality, l.quality) IS NOT NULL
""")
def fill_from_lookup(t: Tables):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 != 0, 9).alias("quality"))
    return joins.fill_from_lookup(d, t.labels, "doc_id", "quality", drop_unmatched=True)


@query("""
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'good'
                    WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'poor' ELSE 'Unknown' END AS status,
       coalesce(CAST(quality AS VARCHAR), 'Unknown') AS label
FROM documents LEFT JOIN labels USING (doc_id)
""")
def cohort_status(t: Tables):
    marked = joins.cohort_status(t.documents.select("doc_id"), {"good": t.labels.where("quality = 1"),
                                                                "poor": t.labels}, "doc_id")
    text = t.labels.select("doc_id", F.col("quality").cast("string").alias("label"))
    return joins.label_or(marked, text, "doc_id", "label", "Unknown")


@query("""
WITH p AS (SELECT DISTINCT o_custkey AS id FROM orders),
     c AS (SELECT DISTINCT doc_id AS id FROM documents)
SELECT coalesce(p.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'left_only' WHEN p.id IS NULL THEN 'right_only' ELSE 'both' END AS match_status
FROM p FULL JOIN c ON p.id = c.id
""")
def match_report(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("id"))
    b = t.documents.select(F.col("doc_id").alias("id"))
    return joins.match_report(a, b, "id")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey AS array_key, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n
           FROM orders WHERE o_orderstatus <> 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
     f AS (SELECT o_custkey, o_totalprice AS age, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n
           FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey))
SELECT p.o_custkey, p.k, array_key, age FROM p JOIN f ON p.o_custkey = f.o_custkey AND p.k = f.k AND p.n = f.n
""")
def zip_join(t: Tables):
    a = t.orders.where("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderkey").alias("array_key"), "o_orderdate")
    b = t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_totalprice").alias("age"), "o_orderkey")
    return joins.zip_join(a, b, "o_custkey", ["o_orderdate", "array_key"], ["age", "o_orderkey"]).select(
        "o_custkey", "k", "array_key", "age")


@query("""
SELECT o_orderkey, o_custkey, false AS removed FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
SELECT o_orderkey, o_custkey, true FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
""")
def exclude_keys(t: Tables):
    bad = F.col("o_orderstatus") == "P"
    kept = dedup.exclude_keys(t.orders, "o_custkey", bad).select("o_orderkey", "o_custkey", F.lit(False).alias("removed"))
    gone = dedup.exclude_keys(t.orders, "o_custkey", bad, removed=True).select(
        "o_orderkey", "o_custkey", F.lit(True).alias("removed"))
    return kept.unionByName(gone)


@query(f"""
WITH {REGION_SQL}
SELECT event_id AS site_id, region_id, value FROM events JOIN regions
  ON chrom = event_type AND event_id BETWEEN region_start AND region_end
""")
def region_join(t: Tables):
    return joins.region_join(sites(t), regions(t)).select("site_id", "region_id", "value")
