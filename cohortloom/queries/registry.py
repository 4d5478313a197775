"""The query registry and the stand-in tables that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name, with the SQL of the same result."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(configure(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(col, digits: int = 6):
    """Round a computed double so that both engines print the same value."""
    return F.round(col, digits)


def sample_sheet(t: Tables) -> dict[str, DataFrame]:
    """Two platform sheets brought to the same names: (code, name, nation, balance)."""
    customers = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"),
                                  F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"),
                                  F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return {"v1": customers, "v2": suppliers}


def embedding_matrix(t: Tables) -> DataFrame:
    """Long matrix: feature = vector place (0-63), sample = vector, batch = label.

    Two covariates follow from the sample id, as a stand-in for age and sex.
    """
    return t.embeddings.select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("batch"),
        (F.col("vec_id") % 37).cast("double").alias("age"),
        F.when(F.col("vec_id") % 3 == 0, "F").otherwise("M").alias("sex"),
        F.posexplode("embedding").alias("feature_id", "v")
    ).withColumn("value", F.col("v").cast("double")).drop("v")


EMBEDDING_SQL = """
  matrix AS (
    SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS batch, CAST(vec_id % 37 AS DOUBLE) AS age,
           CASE WHEN vec_id % 3 = 0 THEN 'F' ELSE 'M' END AS sex,
           CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature_id,
           CAST(unnest(embedding) AS DOUBLE) AS value
    FROM embeddings)
"""


def probe_matrix(t: Tables) -> DataFrame:
    """Long matrix with spread and detection layers: feature = part, sample = line number."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_linenumber").alias("sample_id")).agg(
        F.avg("l_extendedprice").alias("value"), F.stddev_samp("l_extendedprice").alias("stdev"),
        F.avg("l_discount").alias("detection"))


PROBE_SQL = """
  probes AS (
    SELECT l_partkey AS feature_id, l_linenumber AS sample_id, avg(l_extendedprice) AS value,
           stddev_samp(l_extendedprice) AS stdev, avg(l_discount) AS detection
    FROM lineitem GROUP BY 1, 2)
"""


def sites(t: Tables) -> DataFrame:
    """Events as measured sites: chrom = event type, pos = event id."""
    return t.events.select(F.col("event_id").alias("site_id"), F.col("event_type").alias("chrom"),
                           F.col("event_id").alias("pos"), F.col("user_id").alias("sample_id"),
                           F.col("value"))


def regions(t: Tables) -> DataFrame:
    """Regions of 250 positions that overlap by 50, as many as the sites need, on every chrom."""
    return t.events.select(F.col("event_type").alias("chrom"), F.floor(F.col("event_id") / 200).alias("k")).distinct(
    ).select("chrom", F.concat_ws(":", "chrom", "k").alias("region_id"), (F.col("k") * 200).alias("start"),
             (F.col("k") * 200 + 249).alias("end"))


REGION_SQL = """
  regions AS (
    SELECT DISTINCT event_type AS chrom, event_type || ':' || (event_id // 200) AS region_id,
           (event_id // 200) * 200 AS region_start, (event_id // 200) * 200 + 249 AS region_end
    FROM events)
"""
