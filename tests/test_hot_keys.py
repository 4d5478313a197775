"""Ordered operators on keys that hold most rows, with the range path forced by a small limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import dedup, ordering, ranking, summaries
from cohortloom.operators.matrix import normalise

LIMIT = 300


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", np.array([f"k{i}" for i in rng.integers(0, 40, n)]))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "v": np.round(rng.normal(0, 3, n), 1)})
    pdf.loc[rng.random(n) < 0.05, "key"] = None
    df = spark.createDataFrame(pdf.astype({"key": object}), "id long, key string, v double").repartition(7).cache()
    return df, pdf


def _numbers(pdf, keys, order):
    ordered = pdf.sort_values(order)
    return ordered.groupby(keys, dropna=False).cumcount() + 1


def test_row_index_inside_keys(skewed):
    df, pdf = skewed
    got = ordering.row_index(df, ["v", "id"], ["key"], "n", max_group=LIMIT).toPandas().set_index("id")["n"].sort_index()
    want = _numbers(pdf.set_index("id", drop=False).rename_axis(None), ["key"], ["v", "id"]).sort_index()
    assert (got.to_numpy() == want.to_numpy()).all()


def test_row_index_over_the_frame(skewed):
    df, pdf = skewed
    got = ordering.row_index(df, [F.col("v").desc(), "id"], out="n", max_group=LIMIT).toPandas().sort_values("n")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist() and got["n"].tolist() == list(range(1, len(pdf) + 1))


def test_both_paths_agree_when_the_order_has_ties(skewed):
    df, pdf = skewed
    got = ordering.row_index(df, ["v"], ["key"], "n", max_group=LIMIT).toPandas()
    for _, g in got.groupby("key", dropna=False):
        assert sorted(g["n"]) == list(range(1, len(g) + 1))
        assert g.sort_values("n")["v"].is_monotonic_increasing


def test_exact_quantiles(skewed):
    df, pdf = skewed
    probs, names = [0, 0.1, 0.5, 0.9, 1], ["a", "b", "c", "d", "e"]
    for limit in (None, LIMIT):
        got = ordering.exact_quantiles(df, ["key"], "v", probs, names, max_group=limit).toPandas().set_index("key")
        for key, g in pdf.groupby("key"):
            assert np.allclose(got.loc[key, names].astype(float), np.quantile(g["v"], probs))
        whole = ordering.exact_quantiles(df, [], "v", probs, names, max_group=limit).first()
        assert np.allclose(list(whole), np.quantile(pdf["v"], probs))


def test_box_stats_paths_agree(skewed):
    df, _ = skewed
    a = summaries.box_stats(df, "key", "v").toPandas().sort_values("key").reset_index(drop=True)
    b = summaries.box_stats(df, "key", "v", max_group=LIMIT).toPandas().sort_values("key").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_repeats_and_sorted_values(skewed):
    df, pdf = skewed
    got = dedup.repeats(df, "key", ["id"], max_group=LIMIT)
    want = pdf[pdf.duplicated("key")]
    assert sorted(r["id"] for r in got.collect()) == sorted(want["id"])
    values = summaries.sorted_values(df, "key", "v", max_group=LIMIT).toPandas()
    hot = values[values["key"] == "hot"].sort_values("position")["v"].tolist()
    assert hot == sorted(pdf[pdf["key"] == "hot"]["v"])


@pytest.mark.parametrize("limit", [None, LIMIT])
def test_is_monotone(spark, limit):
    n = 400
    rows = [("up", i, float(i // 3)) for i in range(n)] + [("down", i, float(i if i != 200 else -1)) for i in range(n)]
    rows += [("one", 0, 5.0), ("edge", 0, 1.0), ("edge", 1, 3.0), ("edge", 2, 2.0)]
    df = spark.createDataFrame(rows, "key string, at int, v double").repartition(5)
    got = {r["key"]: r["monotone"] for r in summaries.is_monotone(df, "key", "v", ["at"], max_group=limit).collect()}
    assert got == {"up": True, "down": False, "one": True, "edge": False}


def test_rank_of_shares_places(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 2, 9, 2])], "id int, v double")
    got = {r["id"]: r["place"] for r in ordering.rank_of(df, "v", "place", max_group=2).collect()}
    assert got == {0: 5, 1: 1, 2: 2, 3: 2, 4: 6, 5: 2}


def test_rank_cutoff_keeps_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 3, 4]], "v double")
    assert ranking.rank_cutoff(df, "v", 2).count() == 4


@pytest.mark.parametrize("limit", [None, 20])
def test_quantile_normalisation_gives_one_distribution(spark, limit):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(f, s, float(np.round(rng.normal(s, 1 + s), 3))) for f in range(90) for s in range(5)],
                       columns=["feature_id", "sample_id", "value"])
    out = normalise.quantile_normalise(spark.createDataFrame(pdf), max_group=limit).toPandas()
    wide = out.pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    raw = pdf.pivot(index="feature_id", columns="sample_id", values="value").to_numpy()
    target = np.sort(raw, axis=0).mean(axis=1)
    for s in range(5):
        if len(set(raw[:, s])) == 90:
            assert np.allclose(np.sort(wide[:, s]), target)
        assert np.isclose(wide[:, s].mean(), target.mean())


def test_nested_rows_come_in_bounded_chunks(skewed):
    df, pdf = skewed
    out = summaries.nest_per_key(df, "key", ["id"], ["id"], chunk=100).toPandas()
    assert out["rows"].map(len).max() <= 100
    hot = out[out["key"] == "hot"].sort_values("chunk")
    assert [r["id"] for rows in hot["rows"] for r in rows] == sorted(pdf[pdf["key"] == "hot"]["id"])


def test_equal_rows_are_counted_before_they_are_ordered(spark, monkeypatch):
    """80 % of all rows are one value: no range of the order may hold more than its share."""
    rows = [(1, 5.0)] * 8000 + [(1, float(i % 700)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    seen = []
    real = ordering._range_pieces
    monkeypatch.setattr(ordering, "_range_pieces", lambda *a: seen.append(real(*a)) or seen[-1])
    got = ordering.exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.99], ["a", "b", "c"], max_group=LIMIT).first()
    assert np.allclose(list(got)[1:], np.quantile([v for _, v in rows], [0.1, 0.5, 0.99]))
    assert max(r["count"] for r in seen[0].groupBy("_piece").count().collect()) <= LIMIT
    positions = summaries.sorted_values(df, "k", "v", max_group=LIMIT).orderBy("position").collect()
    assert [r["v"] for r in positions] == sorted(v for _, v in rows) and positions[-1]["position"] == len(rows)
