"""Sorting, numbering, z-scores, top rows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import ranking, summaries
from cohortloom.operators.matrix import core
from cohortloom.operators.matrix import reduce as red
from cohortloom.queries.registry import EMBEDDING_SQL, Tables, embedding_matrix, query, r


@query("""
WITH s AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events)
SELECT event_id, kind, row_number() OVER (ORDER BY kind DESC NULLS LAST, event_id) AS place FROM s
""")
def sort_nulls_last(t: Tables):
    src = t.events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    # The numbered rows show the order; sorting by the number repeats it.
    placed = ranking.row_index(src, [F.col("kind").desc_nulls_last(), "event_id"], out="place")
    return ranking.sort_nulls_last(placed, "-kind", "event_id")


@query("""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS sample FROM events
""")
def row_index(t: Tables):
    return ranking.row_index(t.events.select("event_id", "event_type", "value"), ["value", "event_id"], ["event_type"],
                             "sample").drop("value")


@query("""
SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS position FROM orders
""")
def sorted_values(t: Tables):
    return summaries.sorted_values(t.orders, "o_custkey", "o_totalprice")


@query("""
SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)
""")
def zscore(t: Tables):
    return ranking.zscore(t.events, "value", "event_type").select("event_id", r("z").alias("z"))


@query("""
SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events
""")
def zscore_pooled(t: Tables):
    return ranking.zscore(t.events, "value").select("event_id", r("z").alias("z"))


@query("""
WITH s AS (SELECT event_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, abs(z) > 2 AS outlier FROM s
""")
def outliers(t: Tables):
    return ranking.flag_outliers(ranking.zscore(t.events, "value", "event_type"), "z").select("event_id", "outlier")


@query(f"""
WITH {EMBEDDING_SQL}, md AS (SELECT feature_id, median(value) AS m FROM matrix GROUP BY 1)
SELECT feature_id, round(1.4826 * median(abs(value - m)), 6) AS mad FROM matrix JOIN md USING (feature_id) GROUP BY 1
ORDER BY 1.4826 * median(abs(value - m)) DESC, feature_id LIMIT 10
""")
def top_mad(t: Tables):
    return red.top_mad(embedding_matrix(t), 10).select("feature_id", r("mad").alias("mad"))


@query("""
SELECT p_partkey, p_size FROM part WHERE p_size <= (SELECT max(p_size) FROM (SELECT p_size FROM part ORDER BY p_size LIMIT 100))
""")
def rank_cutoff(t: Tables):
    return ranking.rank_cutoff(t.part.select("p_partkey", "p_size"), "p_size", 100)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 13")
def sample_n(t: Tables):
    return ranking.sample_n(t.documents.select("doc_id", "lang"), 13, 7, ["doc_id"])


@query(f"WITH {EMBEDDING_SQL} SELECT feature_id, sample_id, round(log2(b / (1 - b)), 6) AS m FROM (SELECT *, (value + 1) / 2 AS b FROM matrix)")
def beta_to_m(t: Tables):
    m = embedding_matrix(t).withColumn("b", (F.col("value") + 1) / 2)
    return m.select("feature_id", "sample_id", r(core.beta_to_m(F.col("b"))).alias("m"))


@query(f"""
WITH {EMBEDDING_SQL}
SELECT feature_id, sample_id, round(value - avg(value) FILTER (WHERE batch = '0') OVER (PARTITION BY feature_id), 6) AS centered FROM matrix
""")
def center_on_group(t: Tables):
    return core.center_on_group(embedding_matrix(t), F.col("batch") == "0").select(
        "feature_id", "sample_id", r("centered").alias("centered"))
