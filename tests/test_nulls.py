"""Missing-value rules on small frames made for them."""

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import columns, predicates, strings
from cohortloom.operators import dedup, joins, ranking, summaries


def _set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def keyed(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("left", 3), ("x", 4)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20), ("right", 30)], "k string, b int")
    return a, b


def test_joins_match_missing_keys(keyed):
    a, b = keyed
    assert _set(joins.natural_join(a, b)) == _set_rows([("x", 1, 10), ("x", 4, 10), (None, 2, 20)])
    assert _set(joins.natural_join(a, b, nulls="never")) == _set_rows([("x", 1, 10), ("x", 4, 10)])
    assert _set(joins.natural_join(a, b, "left")) == _set_rows(
        [("x", 1, 10), ("x", 4, 10), (None, 2, 20), ("left", 3, None)])


def _set_rows(rows):
    return sorted(rows, key=repr)


def test_semi_and_anti_treat_missing_as_a_value(keyed):
    a, b = keyed
    assert _set(joins.keep_in(a, b, "k")) == _set_rows([("x", 1), ("x", 4), (None, 2)])
    assert _set(joins.drop_in(a, b, key="k")) == [("left", 3)]
    no_null = b.where("k is not null")
    assert _set(joins.drop_in(a, no_null, key="k")) == _set_rows([(None, 2), ("left", 3)])
    assert _set(joins.drop_in(a, no_null, b, key="k")) == [("left", 3)]


def test_join_suffixes_and_no_fan_out(spark):
    a = spark.createDataFrame([(1, "p"), (2, "q")], "k int, name string")
    b = spark.createDataFrame([(1, "r")], "k int, name string")
    out = joins.join_on(a, b, "k")
    assert out.columns == ["k", "name_x", "name_y"] and _set(out) == [(1, "p", "r")]
    assert joins.join_on(a, b, "k", "left").count() == 2


def test_match_report(keyed):
    a, b = keyed
    assert _set(joins.match_report(a, b, "k")) == _set_rows(
        [("x", "both"), (None, "both"), ("left", "left_only"), ("right", "right_only")])


def test_lookup_fill_and_status(spark):
    a = spark.createDataFrame([("s1", None), ("s2", 5), ("s3", None), (None, None)], "slide string, batch int")
    b = spark.createDataFrame([("s1", 7), ("s2", 9), ("s1x", 1)], "slide string, batch int")
    assert _set(joins.fill_from_lookup(a, b, "slide", "batch")) == _set_rows(
        [("s1", 7), ("s2", 5), ("s3", None), (None, None)])
    assert _set(joins.fill_from_lookup(a, b, "slide", "batch", drop_unmatched=True)) == _set_rows([("s1", 7), ("s2", 5)])
    status = joins.cohort_status(a.select("slide"), {"b": b, "odd": b.where("batch = 1")}, "slide")
    assert _set(status) == _set_rows([("s1", "b"), ("s2", "b"), ("s3", "Unknown"), (None, "Unknown")])
    found = joins.lookup_first(a.select("slide"), b.withColumn("at", F.col("batch")), "slide", "at")
    assert {r["slide"]: r["first_position"] for r in found.collect()} == {"s1": 7, "s2": 9, "s3": None, None: None}


@pytest.mark.parametrize("text,key,hit", [("123", "12", True), ("123", "123", True), ("12", "123", False),
                                          ("a.b", ".", True), ("abc", ".", False), (None, "1", False), ("x", "", True)])
def test_substring_match_is_literal(spark, text, key, hit):
    a = spark.createDataFrame([(text,)], "t string")
    b = spark.createDataFrame([(key,), (None,)], "k string")
    assert joins.match_substring(a, b, "t", "k", exact=False).count() == int(hit)
    assert joins.match_substring(a, b, "t", "k", exact=True).count() == int(text == key)


def test_substring_match_keeps_repeated_rows(spark):
    a = spark.createDataFrame([("ab",), ("ab",), ("zz",)], "t string")
    b = spark.createDataFrame([("a",), ("b",), ("ab",)], "k string")
    assert joins.match_substring(a, b, "t", "k", exact=False).count() == 2


def test_regex_tests(spark):
    df = spark.createDataFrame([("cat",), ("dog",), ("",), (None,)], "t string")
    t = F.col("t")
    assert _set(df.where(predicates.matches(t, "a"))) == [("cat",)]
    assert _set(df.where(~predicates.matches(t, "a"))) == _set_rows([("dog",), ("",), (None,)])
    assert _set(df.where(~predicates.matches(t, "a", nulls="null"))) == _set_rows([("dog",), ("",)])
    assert _set(df.where(predicates.any_of(t, ["ca", "og$"]))) == _set_rows([("cat",), ("dog",)])
    assert _set(df.where(predicates.any_of(t, ["ca", "dog"], anchored=True))) == [("dog",)]
    assert _set(df.where(predicates.symbol_in_text("GRN", t))) == [("",)]


def test_label_pairs(spark):
    rows = [("AD", "ad"), ("Unknown", "x"), (None, None), (None, "x"), ("bv FTD", "bvFTD"), ("y", "unknown")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert _set(df.where(predicates.differs_ci(F.col("a"), F.col("b")))) == _set_rows(
        [("Unknown", "x"), (None, "x"), ("bv FTD", "bvFTD"), ("y", "unknown")])
    assert _set(columns.cross_fill(df, "a", "b")) == _set_rows(
        [("AD", "ad"), ("x", "x"), (None, None), ("x", "x"), ("bv FTD", "bvFTD"), ("y", "y")])


def test_text_functions(spark):
    df = spark.createDataFrame([("a_21_2",), ("x y z_1-b",), ("",), (None,), ("a$b",)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(strings.replace_first(t, "_2", "")).collect()] == ["a1_2", "x y z_1-b", "", None, "a$b"]
    assert [r[0] for r in df.select(strings.clean_id(t)).collect()] == ["a", "xy z", "", None, "a$b"]
    assert [r[0] for r in df.select(strings.split_after(t, "_")).collect()] == ["21_2", "1-b", "", "", ""]
    assert [r[0] for r in df.select(strings.replace_all(t, "[ab]", "$1")).collect()] == ["$1_21_2", "x y z_1-$1", "", None, "$1$$1"]
    labels = spark.createDataFrame([("svPPA",), ("nfPPA/ Unspec. PPA",), ("AD",), (None,)], "d string")
    assert [r[0] for r in labels.select(strings.recode(F.col("d"))).collect()] == ["SD", "PNFA", "AD", None]
    dates = spark.createDataFrame([("2016-02-29",), ("2015-02-29",), ("x",), (None,)], "d string")
    assert [str(r[0]) for r in dates.select(strings.parse_date(F.col("d"))).collect()] == ["2016-02-29", "None", "None", "None"]


def test_composite_keys_and_codes(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), (None, "1")], "p string, q string")
    got = [[r[0] for r in df.select(columns.composite_key([F.col("p"), F.col("q")], m)).collect()]
           for m in ("null", "text", "optional")]
    assert got == [["a_1", None, None], ["a_1", "a_NA", "NA_1"], ["a_1", "a", None]]
    assert [r[0] for r in df.select(columns.factor_code(F.col("p"), ["b", "a"])).collect()] == [2, 2, None]
    assert _set(columns.cast_or_null(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), {"v": "int"})) == _set_rows(
        [(1,), (None,), (None,)])


def test_age_rules(spark):
    ages = spark.createDataFrame([("a", -1.0), ("a", 40.0), ("b", 0.5), ("c", 150.0), ("d", 151.0), ("e", None), ("e", 30.0)],
                                 "p string, age double")
    bad = (F.col("age") < 1) | (F.col("age") > 150)
    assert _set(dedup.invalidate_key(ages, "p", bad, ["age"])) == _set_rows(
        [("a", None), ("a", None), ("b", None), ("c", 150.0), ("d", None), ("e", None), ("e", 30.0)])
    kept, gone = dedup.exclude_keys(ages, "p", bad), dedup.exclude_keys(ages, "p", bad, removed=True)
    assert kept.count() + gone.count() == ages.count()
    assert {r["p"] for r in kept.collect()} == {"c", "e"}
    assert [r[0] for r in ages.select(predicates.in_range(F.col("age"), 1, 150, [40])).collect()] == [
        False, False, False, True, False, None, True]


def test_counts_drop_missing_keys_and_duplicates_keep_them(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4), ("b", 5)], "k string, v int")
    assert _set(summaries.count_per_key(df, "k")) == [("a", 2), ("b", 1)]
    assert _set(dedup.first_per_key(df, "k", ["v"])) == _set_rows([("a", 1), ("b", 5), (None, 2)])
    assert _set(dedup.repeats(df, "k", ["v"])) == _set_rows([("a", 4), (None, 3)])
    assert dedup.dup_groups(df, "k").count() == 4
    assert tuple(dedup.dup_count(df, "k").first()) == (5, 3, 2)


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, v double")
    assert _set(summaries.aggregate_strict(df, "k", "v", "max", "m")) == _set_rows([("a", None), ("b", 4.0), ("c", None)])
    assert _set(summaries.aggregate_strict(df, "k", "v", "mean", "m", na_rm=True)) == [("a", 1.0), ("b", 3.0)]
    assert _set(summaries.null_count(df, "k", "v")) == [("a", 1), ("b", 0), ("c", 1)]
    assert _set(summaries.distinct_per_key(df, "k", "v")) == [("a", 2, False), ("b", 2, False), ("c", 1, True)]


def test_group_summary_levels_and_empty_groups(spark):
    df = spark.createDataFrame([("g", "F", 1.0), ("g", "F", None), ("h", "M", None), ("g", "?", 3.0)],
                               "g string, s string, age double")
    out = summaries.group_summary(df, "g", "s", "age", ["F", "M"])
    assert _set(out) == [("g", 2, 0, 2, 2.0, 1)]
    assert summaries.group_summary(df, "g", "s", "age", ["F", "M"], keep_empty=True).count() == 2
    assert _set(summaries.crosstab_total(df, "g", "s", ["F", "M"])) == [("g", 2, 0, 2), ("h", 0, 1, 1)]


def test_sources_and_priority(spark):
    a = spark.createDataFrame([("s1", 1), ("s2", 1)], "slide string, batch int")
    b = spark.createDataFrame([("s2", 1), ("s2", 2), ("s3", 3)], "slide string, batch int")
    assert _set(dedup.dedup_priority([a, b], "slide", ["batch"])) == [("s1", 1), ("s2", 1), ("s3", 3)]
    assert dedup.distinct_rows([a, b]).count() == 4
    assert dedup.stack([a, b]).count() == 5
    assert _set(dedup.union_prefer(a, b, "batch")) == [("s1", 1), ("s2", 1), ("s2", 2), ("s3", 3)]


def test_zip_join_gate(spark):
    arrays = spark.createDataFrame([("p", "b2", 2), ("p", "b1", 1), ("q", "b1", 1), ("q", "b2", 2), ("r", "b1", 1)],
                                   "k string, slide string, batch int")
    ages = spark.createDataFrame([("p", 60.0), ("p", 50.0), ("q", 70.0), ("r", 33.0)], "k string, age double")
    out = joins.zip_join(arrays, ages, "k", ["batch"], ["age"], place="nth").select("k", "slide", "age")
    assert _set(out) == [("p", "b1", 50.0), ("p", "b2", 60.0), ("r", "b1", 33.0)]
    open_end = joins.zip_join(arrays, ages, "k", ["batch"], ["age"], gate=False, place="nth")
    assert open_end.count() == 4


def test_zscores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "f string, v double")
    per = {(r["f"], r["v"]): r["z"] for r in ranking.zscore(df, "v", "f").collect()}
    assert abs(per[("a", 1.0)] + 2 ** -0.5) < 1e-12 and per[("b", 5.0)] is None
    pooled = [r["z"] for r in ranking.zscore(df, "v").collect() if r["z"] is not None]
    assert abs(sum(pooled)) < 1e-12


def test_fold_difference(spark):
    df = spark.createDataFrame([("a", 2, 10.0), ("a", 1, 7.0), ("b", 1, 4.0)], "k string, o int, v double")
    assert _set(summaries.fold_difference(df, "k", "v", ["o"])) == [("a", 3.0), ("b", 4.0)]


def test_replace_first_keeps_the_patterns_own_rules(spark):
    from cohortloom.functions import strings

    texts = ["a_b\nc", "a\nb axb", "xaay", "😀 b_c", "", None, "x.y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(strings.strip_suffix(F.col("t"), "_").alias("cut"), strings.replace_first(F.col("t"), "a.b", "<>").alias("dot"),
                    strings.replace_first(F.col("t"), r"(a)\1", "$").alias("twice"), strings.replace_first(F.col("t"), "q*", "^").alias("none"),
                    strings.replace_first(F.col("t"), "_c$", "!").alias("wide")).collect()
    assert [r["cut"] for r in got] == ["a_b\nc", "a\nb axb", "xaay", "😀 b", "", None, "x.y"]
    assert [r["dot"] for r in got][:2] == ["a_b\nc".replace("a_b", "<>"), "a\nb <>"]
    assert got[2]["twice"] == "x$y" and got[0]["none"] == "^a_b\nc" and got[3]["wide"] == "😀 b!"


def test_fold_difference_is_null_with_a_null_and_takes_any_order(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 1.0), ("b", 1, 5.0), ("b", 2, 1.0), ("b", 3, 1.5)],
                               "k string, o int, v double")
    got = dict(map(tuple, summaries.fold_difference(df, "k", "v", ["o"]).collect()))
    assert got == {"a": None, "b": 2.5}
    assert dict(map(tuple, summaries.fold_difference(df, "k", "v", [F.col("o").desc_nulls_last()]).collect()))["b"] == 4.5


def test_cross_fill_takes_codes_per_column(spark):
    from cohortloom.functions import columns

    df = spark.createDataFrame([("UNSPECIFIED", "x"), ("y", "UNKNOWN"), ("y", "UNSPECIFIED")], "a string, b string")
    got = columns.cross_fill(df, "a", "b", ["UNSPECIFIED"], ["UNKNOWN"]).collect()
    assert [tuple(r) for r in got] == [("x", "x"), ("y", "y"), ("y", "UNSPECIFIED")]


def test_substrings_of_all_key_lengths(spark):
    from cohortloom.operators import joins

    texts = ["", "abc", "xabcdefghi", "aaaa", "hello world", None, "é😀z"]
    keys = ["abc", "cdefg", "o w", "😀", "aaaaa", "zz", None]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for own in (keys, [*keys, ""], [None]):
        b = spark.createDataFrame([(k,) for k in own], "k string")
        want = {i for i, t in enumerate(texts) if t is not None and any(k is not None and k in t for k in own)}
        assert {r["i"] for r in joins.match_substring(a, b, "t", "k", exact=False).collect()} == want
