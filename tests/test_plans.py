"""Physical plans: joins by hash, pushed filters, pruned columns, split hot keys."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from cohortloom.operators import dedup, joins, ranking, summaries
from cohortloom.session import configure

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


CROSSING = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["join_semi", "join_anti", "match_exact", "match_substring", "region_join", "region_mean",
                                  "zscore", "zscore_pooled", "rank_cutoff", "threshold_counts", "zip_join", "combat",
                                  "sample_records", "match_report", "tukey_hsd", "quantile_norm"])
def test_no_pair_of_tables_is_crossed(spark, name):
    plan = _plan(entry_point.queries()[name](spark, FOLDER))
    assert not any(word in plan for word in CROSSING)


def test_key_list_becomes_a_semi_join(spark):
    plan = _plan(entry_point.queries()["match_exact"](spark, FOLDER))
    assert "LeftSemi" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry_point.queries()["filter_eq"](spark, FOLDER)
    text = _plan(plan)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in text
    summary = _plan(entry_point.queries()["group_summary"](spark, FOLDER))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in summary
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in summary


def test_first_row_is_cut_before_the_shuffle(spark):
    plan = _plan(entry_point.queries()["first_per_key"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


@pytest.fixture()
def small_join_limits(spark):
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    configure(spark)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_key_is_split_in_joins(spark, small_join_limits):
    hot = spark.range(0, 200_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("key"), F.rand(1).alias("v"))
    for df in (ranking.zscore(hot, "v", "key"), dedup.exclude_keys(hot, "key", F.col("v") < 0.0005),
               joins.keep_in(hot, hot.where("v < 0.01"), "key"), dedup.dup_groups(hot, "key"),
               dedup.invalidate_key(hot, "key", F.col("v") < 0.0005, ["v"])):
        assert "SortMergeJoin(skew=true)" in _final_plan(df)


def test_counts_fold_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    for out in (summaries.count_per_key(df, "k"), summaries.crosstab_total(df, "k", "v", ["1.0"]),
                summaries.aggregate_strict(df, "k", "v", "max", "m")):
        text = _plan(out)
        assert "partial_" in text and text.count("Exchange") == 1
