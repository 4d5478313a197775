"""The interval join against a comparison of all sites with all regions."""

import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import joins

SITES, REGIONS = "site long, chrom string, pos double", "region string, chrom string, start double, end double"


def tables(spark, seed):
    rng = random.Random(seed)
    sites = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-300, 300), rng.uniform(-5, 5)])) for i in range(300)]
    regions = []
    for i in range(120):
        start = rng.randrange(-400, 300) + rng.choice([0, 0.5])
        width = rng.choice([0, 0.25, 1, 2, 3, 7, 8, 63, 64, 65, 10 ** 12])
        regions.append((f"r{i}", rng.choice(["a", "b", "c"]), start, rng.choice([start + width, start - 1, None])
                        if i % 9 == 0 else start + width))
    double = lambda rows: [tuple(float(x) if isinstance(x, int) and j > 1 else x for j, x in enumerate(r)) for r in rows]
    sites, regions = double(sites), double(regions)
    want = {(s, r) for s, c, p in sites for r, d, a, b in regions if c == d and c and None not in (p, a, b) and a <= p <= b}
    return spark.createDataFrame(sites, SITES), spark.createDataFrame(regions, REGIONS), want, sites


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_inner_and_left(spark, seed, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    sites, regions, want, rows = tables(spark, seed)
    inner = joins.region_join(sites, regions)
    assert inner.columns == ["site", "chrom", "pos", "region", "start", "end"]
    pairs = [(r["site"], r["region"]) for r in inner.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    left = [(r["site"], r["region"]) for r in joins.region_join(sites, regions, "left").collect()]
    alone = {s for s, *_ in rows} - {s for s, _ in want}
    assert sorted(left, key=str) == sorted([*want, *((s, None) for s in alone)], key=str)
    with pytest.raises(ValueError):
        joins.region_join(sites, regions, "outer")


def test_wide_regions_stay_two_rows(spark):
    """A region over a whole chromosome is no longer than any other, and candidates are at most four times the hits."""
    sites = spark.range(0, 40_000).select(F.col("id").alias("site"), F.lit("a").alias("chrom"), F.col("id").alias("pos"))
    wide = spark.range(5).select(F.concat(F.lit("w"), "id").alias("region"), F.lit("a").alias("chrom"),
                                 F.lit(0).cast("long").alias("start"), F.lit(10 ** 15).alias("end"))
    narrow = spark.range(0, 40_000, 10).select(F.concat(F.lit("n"), "id").alias("region"), F.lit("a").alias("chrom"),
                                               F.col("id").alias("start"), (F.col("id") + 9).alias("end"))
    out = joins.region_join(sites, wide.union(narrow))
    assert out.count() == 5 * 40_000 + 40_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" in plan
    empty = joins.region_join(sites, wide.limit(0))
    assert empty.count() == 0 and joins.region_join(sites, wide.limit(0), "left").count() == 40_000
