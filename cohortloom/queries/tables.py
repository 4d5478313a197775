"""Sources, sinks, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import dedup, ranking
from cohortloom.operators.matrix import core
from cohortloom.queries.registry import REGION_SQL, Tables, query, r, regions, sample_sheet
from cohortloom.session import scratch_path
from cohortloom.sources.probes import long_to_wide, wide_to_long
from cohortloom.sources.readers import read_glob, read_table
from cohortloom.sources import writers
from cohortloom.sources.writers import write_table

CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_table(t.customer, path, "csv")
    return read_table(t.spark, path, CUSTOMER_SCHEMA, "csv")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_tsv(t: Tables):
    path = scratch_path(t.spark, "tsv")
    write_table(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), path, "tsv", header=False)
    return read_table(t.spark, path, "doc_id long, text string, lang string, source string, n_chars long", "tsv", header=False)


@query("SELECT code, name, nation, balance FROM (SELECT s_suppkey AS code, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier)")
def src_glob(t: Tables):
    path = scratch_path(t.spark, "sheets")
    for name, sheet in sample_sheet(t).items():
        write_table(sheet, f"{path}/{name}", "tsv" if name == "v2" else "parquet")
    # The tab-separated sheet is written as *.csv parts by the csv writer, the other as *.parquet.
    return read_glob(t.spark, path, "code long, name string, nation int, balance double", "*.csv").drop("source_file")


def _wide(t: Tables):
    flags = ["A", "N", "R"]
    return t.lineitem.groupBy("l_partkey").agg(*[
        c for f in flags for c in (
            F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f"{f}.signal"),
            F.avg(F.when(F.col("l_returnflag") == f, F.col("l_discount"))).alias(f"{f}.pval"))])


@query("""
WITH f(sample_id) AS (VALUES ('A'), ('N'), ('R')), p AS (SELECT DISTINCT l_partkey FROM lineitem)
SELECT p.l_partkey AS feature_id, f.sample_id, round(avg(l_extendedprice), 6) AS value, round(avg(l_discount), 6) AS detection
FROM p CROSS JOIN f LEFT JOIN lineitem l ON l.l_partkey = p.l_partkey AND l.l_returnflag = f.sample_id GROUP BY 1, 2
""")
def matrix_unpivot(t: Tables):
    long = wide_to_long(_wide(t), "l_partkey", {".signal": "value", ".pval": "detection"})
    return long.select("feature_id", "sample_id", r("value").alias("value"), r("detection").alias("detection"))


@query("""
SELECT l_partkey AS feature_id, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 6) AS "A",
  round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 6) AS "N",
  round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY 1
""")
def matrix_pivot(t: Tables):
    long = core.collapse_dups(t.lineitem.select(F.col("l_partkey").alias("feature_id"),
                                                F.col("l_returnflag").alias("sample_id"),
                                                F.col("l_extendedprice").alias("value")))
    wide = long_to_wide(long, ["A", "N", "R"])
    return wide.select("feature_id", *[r(c).alias(c) for c in ("A", "N", "R")])


@query("""
WITH s AS (SELECT event_id, event_type, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type) AS z FROM events)
SELECT event_id, event_type AS platform, round(z, 6) AS z, z < -1 AS low_flag FROM s
""")
def flag_low(t: Tables):
    scored = ranking.zscore(t.events, "value", "event_type")
    flagged = ranking.flag_outliers(scored, "z", 1.0, "low", "low_flag").select(
        "event_id", F.col("event_type").alias("platform"), r("z").alias("z"), "low_flag")
    path = scratch_path(t.spark, "sheets")
    write_table(flagged, path, "parquet", partition_by=["platform"])
    return read_table(t.spark, path, flagged.schema, "parquet")


@query(f"WITH {REGION_SQL} SELECT chrom, region_start - 1 AS start, region_end AS \"end\", region_id AS name FROM regions")
def export_bed(t: Tables):
    path = scratch_path(t.spark, "bed")
    writers.export_bed(regions(t), path)
    return read_table(t.spark, path, "chrom string, start long, end long, name string", "tsv", header=False)


@query("""
SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def first_per_key(t: Tables):
    return dedup.first_per_key(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@query("""
SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1
""")
def repeats(t: Tables):
    return dedup.repeats(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@query("SELECT doc_id, text FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")
def dup_groups(t: Tables):
    return dedup.dup_groups(t.documents.select("doc_id", "text"), "text")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_surplus FROM documents")
def dup_count(t: Tables):
    return dedup.dup_count(t.documents, "text")


_YEARS = "o_orderdate >= TIMESTAMP '{0}-01-01 00:00:00' AND o_orderdate < TIMESTAMP '{1}-01-01 00:00:00'"


@query(f"""
WITH s AS (SELECT o_orderkey, o_custkey, 0 AS src FROM orders WHERE {_YEARS.format(1900, 1997)}
           UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE {_YEARS.format(1997, 2100)}),
     k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src, o_orderkey) AS rn FROM s)
SELECT o_orderkey, o_custkey FROM k WHERE rn = 1
""")
def dedup_priority(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    first = rows.where(_YEARS.format(1900, 1997)).drop("o_orderdate")
    second = rows.where(_YEARS.format(1997, 2100)).drop("o_orderdate")
    return dedup.dedup_priority([first, second], "o_custkey", ["o_orderkey"])


@query("SELECT lang, source FROM documents UNION SELECT lang, source FROM documents WHERE n_chars > 1000")
def distinct_rows(t: Tables):
    pairs = t.documents.select("lang", "source", "n_chars")
    return dedup.distinct_rows([pairs.drop("n_chars"), pairs.where("n_chars > 1000").drop("n_chars")])


@query("""
SELECT c_custkey AS code, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, 'v1' AS platform FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'v2' FROM supplier
""")
def union_all(t: Tables):
    return dedup.stack(sample_sheet(t), "platform")


@query("""
SELECT s_suppkey AS code, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def union_prefer(t: Tables):
    sheets = sample_sheet(t)
    return dedup.union_prefer(sheets["v2"], sheets["v1"], "code")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def intersect_keys(t: Tables):
    return dedup.intersect_keys(t.documents, t.labels, "doc_id")


@query("""
SELECT l_orderkey AS feature_id, l_linenumber AS sample_id, l_extendedprice AS value FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')
""")
def matrix_combine(t: Tables):
    """All lines, open and closed ones as two matrices; orders without an open line are features that the first one lacks."""
    def cells(condition):
        return t.lineitem.where(condition).select(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("sample_id"),
                                                  F.col("l_extendedprice").alias("value"))

    return core.combine(cells("l_linestatus = 'O'"), cells("l_linestatus <> 'O'"))
