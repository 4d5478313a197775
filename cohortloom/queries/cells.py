"""Columns, cells, predicates and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import columns, predicates, strings
from cohortloom.operators import dedup
from cohortloom.operators.joins import attach
from cohortloom.operators.matrix import core
from cohortloom.queries.registry import Tables, query


@query("SELECT c_custkey, c_mktsegment FROM customer")
def project(t: Tables):
    return t.customer.select("c_custkey", "c_mktsegment")


@query("SELECT * EXCLUDE (c_acctbal, c_nationkey) FROM customer")
def drop_cols(t: Tables):
    return t.customer.drop("c_acctbal", "c_nationkey")


@query("SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def col_range(t: Tables):
    li = t.lineitem
    return li.select("l_orderkey", *columns.column_range(li, "l_quantity", "l_tax"))


@query("""
SELECT doc_id, 'labels' AS side FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents
""")
def common_cols(t: Tables):
    names = columns.common_columns(t.labels, t.documents, exclude="^text$")
    return dedup.stack({"labels": t.labels.select(*names), "documents": t.documents.select(*names)}, "side")


@query("""SELECT p_partkey AS "PROBE_ID", p_name AS "P_NAME", p_size AS "SIZE" FROM part""")
def harmonise_names(t: Tables):
    return columns.harmonise_names(t.part.select("p_partkey", "p_name", "p_size"),
                                   {"P_PARTKEY": "PROBE_ID", "P_SIZE": "SIZE"}, upper=True)


@query("""
SELECT s_suppkey, 38 AS batch, 'v4' AS platform, CAST(NULL AS DOUBLE) AS age, 'Unknown' AS diagnosis FROM supplier
""")
def const_col(t: Tables):
    return columns.constant_columns(t.supplier.select("s_suppkey"), {
        "batch": (38, "int"), "platform": ("v4", "string"), "age": (None, "double"), "diagnosis": ("Unknown", "string")})


@query("""
SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS level, TRY_CAST(o_orderstatus AS DOUBLE) AS status,
       TRY_CAST(o_totalprice AS VARCHAR) AS price
FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice FROM orders)
""")
def cast_null(t: Tables):
    src = t.orders.select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("level"),
                          F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("price"))
    return columns.cast_or_null(src, {"level": "int", "status": "double", "price": "string"})


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderstatus END AS a,
                  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS b FROM orders),
     k AS (SELECT *, a IS NOT NULL AND upper(a) <> 'UNKNOWN' AS ka, b IS NOT NULL AND upper(b) <> 'UNKNOWN' AS kb FROM s)
SELECT o_orderkey, CASE WHEN NOT ka AND kb THEN b ELSE a END AS a, CASE WHEN NOT kb AND ka THEN a ELSE b END AS b FROM k
""")
def cross_fill(t: Tables):
    k = F.col("o_orderkey")
    src = t.orders.select(
        k, F.when(k % 3 == 0, None).when(k % 7 == 0, "unknown").otherwise(F.col("o_orderstatus")).alias("a"),
        F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("b"))
    return columns.cross_fill(src, "a", "b")


@query("SELECT event_id, coalesce(nullif(event_type, 'error'), 'None') AS notes FROM events")
def fill_default(t: Tables):
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("notes")).fillna({"notes": "None"})


@query("""
WITH s AS (SELECT p_partkey, p_brand, nullif(p_type, 'ECONOMY') AS pos FROM part)
SELECT p_partkey, CASE WHEN pos IS NULL THEN p_brand ELSE p_brand || '_' || pos END AS optional_key,
       p_brand || '_' || pos AS null_key, p_brand || '_' || coalesce(pos, 'NA') AS text_key FROM s
""")
def composite_key(t: Tables):
    parts = [F.col("p_brand"), F.nullif("p_type", F.lit("ECONOMY"))]
    return t.part.select("p_partkey", *[columns.composite_key(parts, m).alias(f"{m}_key")
                                        for m in ("optional", "null", "text")])


@query("""
SELECT sample_id, feature_id, value, grp FROM (
  SELECT vec_id AS sample_id, label AS grp, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature_id,
         CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
""")
def matrix_with_pheno(t: Tables):
    long = t.embeddings.select(F.col("vec_id").alias("sample_id"),
                               F.posexplode("embedding").alias("feature_id", "value")
                               ).withColumn("value", F.col("value").cast("double"))
    pheno = t.embeddings.select(F.col("vec_id").alias("sample_id"), F.col("label").alias("grp"))
    return core.with_pheno(long, pheno)


@query("""
SELECT o_orderkey, CAST(nullif(list_position(['F','O'], o_orderstatus), 0) AS INTEGER) AS declared,
       CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS sorted_code FROM orders
""")
def factor_code(t: Tables):
    codes = core.default_levels(t.orders, "o_orderpriority", "sorted_code")
    return attach(t.orders, codes, "o_orderpriority").select(
        "o_orderkey", columns.factor_code(F.col("o_orderstatus"), ["F", "O"]).alias("declared"), "sorted_code")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 300000)")
def filter_eq(t: Tables):
    return t.orders.where((F.col("o_orderstatus") == "F")
                          & ((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 300000))
                          ).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, v FROM (SELECT event_id, nullif(event_type, 'error') AS v FROM events) WHERE v <> 'click'")
def filter_ne(t: Tables):
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("v")).where(F.col("v") != "click")


@query("""
SELECT part_id, CASE WHEN size >= 7 THEN 'good' ELSE 'bad' END AS rin FROM (
  SELECT p_partkey AS part_id, nullif(p_size, 11) AS size FROM part) WHERE size IS NOT NULL
""")
def threshold_split(t: Tables):
    src = t.part.select(F.col("p_partkey").alias("part_id"), F.nullif("p_size", F.lit(11)).alias("size"))
    bad = src.where("size < 7").select("part_id", F.lit("bad").alias("rin"))
    good = src.where("size >= 7").select("part_id", F.lit("good").alias("rin"))
    return bad.unionByName(good)


@query("""
SELECT event_id, value FROM events WHERE NOT (value >= 1 AND value <= 15 AND value <> 6.55)
""")
def invalid_rows(t: Tables):
    return t.events.select("event_id", "value").where(~predicates.in_range(F.col("value"), 1, 15, [6.55]))


@query("""
WITH bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 50000)
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (FROM bad) THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders
""")
def invalidate_key(t: Tables):
    return dedup.invalidate_key(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey",
                                F.col("o_totalprice") < 50000, ["o_totalprice"])


@query("""
SELECT event_id, a, b FROM (SELECT event_id, nullif(event_type, 'error') AS a, nullif(value, 6.55) AS b FROM events)
WHERE a IS NOT NULL AND b IS NOT NULL
""")
def complete_cases(t: Tables):
    src = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("a"),
                          F.nullif("value", F.lit(6.55)).alias("b"))
    return predicates.complete_cases(src, ["a", "b"])


def _noted(t: Tables):
    """Parts with one name blanked, as there is no missing text in the tables."""
    return t.part.select("p_partkey", F.nullif("p_name", F.lit("small ring")).alias("note"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'red|^small')")
def regex_keep(t: Tables):
    return t.part.select("p_partkey", "p_name").where(predicates.matches(F.col("p_name"), "red|^small"))


@query("""
WITH s AS (SELECT p_partkey, nullif(p_name, 'small ring') AS note FROM part)
SELECT p_partkey, note FROM s WHERE NOT coalesce(regexp_matches(note, 'red'), false)
""")
def regex_drop(t: Tables):
    return _noted(t).where(~predicates.matches(F.col("note"), "red"))


@query("""
WITH s AS (SELECT p_partkey, nullif(p_name, 'small ring') AS note FROM part)
SELECT p_partkey, note FROM s WHERE NOT regexp_matches(note, 'red')
""")
def regex_drop_nulls(t: Tables):
    return _noted(t).where(
        ~predicates.matches(F.col("note"), "red", nulls="null"))


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches('the french text', lang)")
def symbol_in_literal(t: Tables):
    return t.documents.select("doc_id", "lang").where(predicates.symbol_in_text("the french text", F.col("lang")))


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(o_orderstatus) END AS a,
                  CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS b FROM orders)
SELECT * FROM s WHERE upper(a) IS DISTINCT FROM upper(b)
""")
def mismatch_rows(t: Tables):
    k = F.col("o_orderkey")
    src = t.orders.select(k, F.when(k % 4 == 0, None).otherwise(F.lower("o_orderstatus")).alias("a"),
                          F.when(k % 8 == 0, None).when(k % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("b"))
    return src.where(predicates.differs_ci(F.col("a"), F.col("b")))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(example\\.com)|(#top)|(/fr/)')")
def regex_any(t: Tables):
    listed = ["example\\.com", "#top", "/fr/"]
    return t.pages.select("page_id", "url").where(~predicates.any_of(F.col("url"), listed))


@query("""
SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(lang, 'en|fr') THEN 'language' END,
  CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN source IS NULL THEN 'source' END) AS reasons
FROM documents WHERE NOT regexp_matches(lang, 'en|fr') OR n_chars < 500 OR source IS NULL
""")
def sample_removal(t: Tables):
    reasons = {"language": ~predicates.matches(F.col("lang"), "en|fr"), "short": F.col("n_chars") < 500,
               "source": F.col("source").isNull()}
    return core.removal_reasons(t.documents.select("doc_id", "lang", "n_chars", "source"), reasons).where(
        F.size("removal_reason") > 0).select("doc_id", F.concat_ws(",", "removal_reason").alias("reasons"))


@query("SELECT c_custkey, regexp_replace(c_name, '0', 'x') AS name FROM customer")
def replace_first(t: Tables):
    return t.customer.select("c_custkey", strings.replace_first(F.col("c_name"), "0", "x").alias("name"))


@query("SELECT c_custkey, regexp_replace(c_name, '0+', '.', 'g') AS name FROM customer")
def replace_all(t: Tables):
    return t.customer.select("c_custkey", strings.replace_all(F.col("c_name"), "0+", ".").alias("name"))


@query("SELECT s_suppkey, upper(s_name) AS name FROM supplier")
def upper_norm(t: Tables):
    return t.supplier.select("s_suppkey", F.upper("s_name").alias("name"))


@query("""
SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN substr(url, strpos(url, '?') + 1) ELSE '' END AS suffix FROM pages
""")
def split_suffix(t: Tables):
    return t.pages.select("page_id", strings.split_after(F.col("url"), "?").alias("suffix"))


@query("SELECT c_custkey, regexp_replace(c_name, '#.*$', '') AS name FROM customer")
def strip_suffix(t: Tables):
    return t.customer.select("c_custkey", strings.strip_suffix(F.col("c_name"), "#").alias("name"))


@query("""
WITH s AS (SELECT p_partkey, p_size || ' ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_2' ELSE '-b' END
                  || CASE WHEN p_partkey % 5 = 0 THEN ' kept' ELSE '' END AS raw FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(raw, ' ', ''), '_.*$', ''), '-.*$', '') AS id,
       CASE WHEN strpos(raw, '_') > 0 THEN substr(raw, strpos(raw, '_') + 1) ELSE '' END AS sample_num
FROM s WHERE NOT regexp_matches(raw, 'kep')
""")
def clean_id(t: Tables):
    key = F.col("p_partkey")
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" "), key.cast("string"),
                   F.when(key % 2 == 0, "_2").otherwise("-b"), F.when(key % 5 == 0, " kept").otherwise(""))
    src = t.part.select("p_partkey", raw.alias("raw")).where(~predicates.matches(F.col("raw"), "kep", nulls="null"))
    return src.select("p_partkey", strings.clean_id(F.col("raw")).alias("id"),
                      strings.split_after(F.col("raw"), "_").alias("sample_num"))


@query("""
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS received
FROM orders
""")
def parse_date(t: Tables):
    text = F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", strings.parse_date(text).alias("received"))
