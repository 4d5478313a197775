"""Counts, strict aggregates, cross-tabulations and group reports.

All of these combine map-side, so a hot key is folded before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach, keep_in
from cohortloom.operators.ordering import (
    SortKey, exact_quantiles, ordered_pieces, row_index, sort_columns, value_places)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def count_per_key(df: DataFrame, key: str | Sequence[str], out: str = "n") -> DataFrame:
    """Rows per key; NULL keys are left out."""
    keys = _keys(key)
    return _known_keys(df, keys).groupBy(*keys).agg(F.count("*").alias(out))


def rows_of_frequent(df: DataFrame, key: str | Sequence[str], min_count: int) -> DataFrame:
    """Rows of keys with at least ``min_count`` rows."""
    return keep_in(df, count_per_key(df, key, "_n").where(F.col("_n") >= min_count), _keys(key))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct values, NULL included."""
    return df.select(*cols).distinct()


def distinct_per_key(df: DataFrame, key: str, value: str, out: str = "n_distinct") -> DataFrame:
    """How many distinct values each key has (NULL is one) and whether there is more than one."""
    pairs = _known_keys(df, [key]).select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias(out)).withColumn("single", F.col(out) == 1)


def counts_agree(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts of keys found in both frames and whether they are equal."""
    both = attach(count_per_key(a, key, "n_a"), count_per_key(b, key, "n_b"), key, "inner")
    return both.withColumn("agree", F.col("n_a") == F.col("n_b"))


def level_counts(col: str, levels: Sequence[str]) -> list[Column]:
    """One zero-filled conditional count per declared level, named by level."""
    return [F.count(F.when(F.col(col) == level, 1)).alias(level) for level in levels]


def crosstab_total(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """Counts of ``col`` levels per ``row`` value, aligned by level name, zero-filled, with a Total
    over the declared levels."""
    counts = _known_keys(df, [row]).groupBy(row).agg(*level_counts(col, levels))
    return counts.withColumn("Total", sum((F.col(f"`{v}`") for v in levels), F.lit(0).cast("long")))


def strict(fn, col: Column) -> Column:
    """The aggregate, or NULL if any input is NULL."""
    return F.when(F.count(F.when(col.isNull(), 1)) == 0, fn(col))


def aggregate_strict(df: DataFrame, key: str | Sequence[str], col: str, fn: str, out: str,
                     na_rm: bool = False) -> DataFrame:
    """mean, min, max or sum per key. ``na_rm=False``: NULL if any value is NULL; otherwise NULLs
    are left out, and keys with nothing else disappear."""
    fns = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    keys = _keys(key)
    src = _known_keys(df, keys)
    if na_rm:
        return src.where(F.col(col).isNotNull()).groupBy(*keys).agg(fns[fn](col).alias(out))
    return src.groupBy(*keys).agg(strict(fns[fn], F.col(col)).alias(out))


def null_count(df: DataFrame, key: str, col: str, out: str = "n_missing") -> DataFrame:
    """Missing values per key."""
    return _known_keys(df, [key]).groupBy(key).agg(F.count(F.when(F.col(col).isNull(), 1)).alias(out))


def group_summary(df: DataFrame, group: str, category: str, value: str, levels: Sequence[str],
                  keep_empty: bool = False) -> DataFrame:
    """Per group: zero-filled count per category level, Total, mean of known values, number unknown.

    One aggregation. Groups without any known value are dropped unless ``keep_empty``.
    """
    out = _known_keys(df, [group]).groupBy(group).agg(
        *level_counts(category, levels),
        F.count(F.when(F.col(category).isin(list(levels)), 1)).alias("Total"),
        F.avg(value).alias("mean_value"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("n_unknown"))
    return out if keep_empty else out.where(F.col("mean_value").isNotNull())


def override_label(df: DataFrame, overrides: DataFrame, key: str, col: str) -> DataFrame:
    """Replace ``col`` by the hand-made override of its key, where there is one."""
    given = overrides.select(key, F.col(col).alias("_given"))
    return attach(df, given, key).withColumn(col, F.coalesce("_given", col)).drop("_given")


def resolve_single(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: its value where it has exactly one distinct value, else NULL with the
    number of distinct values."""
    pairs = _known_keys(df, [key]).select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("n_distinct"), F.max(value).alias("_v")).select(
        key, "n_distinct", F.when(F.col("n_distinct") == 1, F.col("_v")).alias(value))


def ungroup_values(df: DataFrame, key: str, value: str, order_by: Sequence[SortKey] | None = None,
                   max_group: int | None = None) -> DataFrame:
    """The distinct values of every key as rows, numbered inside the key (``position`` from 1)."""
    pairs = _known_keys(df, [key]).select(key, value).distinct()
    return row_index(pairs, order_by or [value], [key], "position", max_group)


def sorted_values(df: DataFrame, key: str, value: str, max_group: int | None = None) -> DataFrame:
    """All known values of every key in ascending order, numbered inside the key."""
    src = _known_keys(df, [key]).select(key, value).where(F.col(value).isNotNull())
    places = value_places(src, [key], value, value, max_group)
    return places.select(key, value, F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("position"))


def nest_per_key(df: DataFrame, key: str, cols: Sequence[str], order_by: Sequence[SortKey],
                 chunk: int = 10_000, out: str = "rows") -> DataFrame:
    """Rows of a key as an ordered list of records, in chunks of bounded length (``chunk`` from 0),
    so a key of any size stays whole without one oversized cell."""
    numbered = row_index(_known_keys(df, [key]), order_by, [key], "_rn")
    record = F.struct("_rn", *cols)
    lists = (numbered.withColumn("chunk", F.floor((F.col("_rn") - 1) / chunk))
             .groupBy(key, "chunk").agg(F.sort_array(F.collect_list(record)).alias(out)))
    return lists.withColumn(out, F.transform(out, lambda r: r.dropFields("_rn")))


def collapse_values(df: DataFrame, col: str, sep: str = "|", chunk: int = 10_000,
                    out: str = "collapsed") -> DataFrame:
    """The distinct values as joined text in sorted order, one row per ``chunk`` values; for reports
    (matching by a list of values is a join)."""
    values = df.select(F.col(col).cast("string").alias("_v")).where("_v is not null").distinct()
    numbered = row_index(values, ["_v"], out="_rn").withColumn("chunk", F.floor((F.col("_rn") - 1) / chunk))
    return numbered.groupBy("chunk").agg(F.concat_ws(sep, F.sort_array(F.collect_list("_v"))).alias(out))


def fold_difference(df: DataFrame, key: str, value: str, order_by: Sequence[SortKey], out: str = "difference"
                    ) -> DataFrame:
    """|x1 - x2 - ... - xn| per key with x1 the first value in the given order; NULL if any value is.
    Folding from the left equals twice the first minus the sum, so no list is built."""
    rows = _known_keys(df, [key])
    firsts = row_index(rows, order_by, [key], "_place").where("_place = 1").select(key, F.col(value).alias("_first"))
    sums = rows.groupBy(key).agg(strict(F.sum, F.col(value)).alias("_sum"))
    return attach(sums, firsts, key).select(key, F.abs(2 * F.col("_first") - F.col("_sum")).alias(out))


def is_monotone(df: DataFrame, key: str, value: str, order_by: Sequence[SortKey], out: str = "monotone",
                max_group: int | None = None) -> DataFrame:
    """Whether the value never falls from one row to the next in the given order, per key."""
    pieces = ordered_pieces(_known_keys(df, [key]), [key], order_by, max_group)
    inner = W.partitionBy(key, "_piece").orderBy(*sort_columns(order_by))
    steps = pieces.select(key, "_piece", F.col(value).alias("_v"), F.lag(value).over(inner).alias("_prev"),
                          F.row_number().over(inner).alias("_rn"))
    ends = steps.groupBy(key, "_piece").agg(
        F.coalesce(F.bool_and(F.col("_v") >= F.col("_prev")), F.lit(True)).alias("_ok"),
        F.min_by("_v", "_rn").alias("_first"), F.max_by("_v", "_rn").alias("_last"))
    across = W.partitionBy(key).orderBy("_piece")
    joined = ends.withColumn("_ok", F.col("_ok") & F.coalesce(
        F.col("_first") >= F.lag("_last").over(across), F.lit(True)))
    return joined.groupBy(key).agg(F.bool_and("_ok").alias(out))


def threshold_counts(df: DataFrame, p: str, effect: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows with p below each threshold, split by the sign of the effect (falls counted negative).
    One pass with two conditional counts per threshold."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(p) < F.lit(t)
        aggs += [F.count(F.when(hit & (F.col(effect) > 0), 1)).alias(f"up_{i}"),
                 (-F.count(F.when(hit & (F.col(effect) < 0), 1))).alias(f"down_{i}")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(d).alias("direction"), F.col(f"{c}_{i}").alias("n"))
        for i, t in enumerate(thresholds) for d, c in (("positive", "up"), ("negative", "down"))]))
    return df.agg(*aggs).select(rows.alias("r")).select("r.*")


def box_stats(df: DataFrame, group: str, value: str, max_group: int | None = None) -> DataFrame:
    """Quartiles, whisker ends (last values within 1.5 box lengths) and number of outliers per group."""
    src = df.select(group, value).dropna()
    quart = exact_quantiles(src, [group], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], max_group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return attach(src, quart, group).groupBy(group).agg(
        F.any_value("q1").alias("q1"), F.any_value("median").alias("median"), F.any_value("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))


def bar_counts(df: DataFrame, x: str, fill: str) -> DataFrame:
    """Rows per pair of factor values."""
    return df.groupBy(x, fill).agg(F.count("*").alias("n"))
