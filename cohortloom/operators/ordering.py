"""Ordered work on groups of any size.

A window over a key sends the whole key to one task. Where a key can hold a large share of
all rows that does not scale, so the operators here first look at the largest group (one
map-side combined count). Small groups use the plain window; otherwise rows are
range-partitioned by (key, order), numbered inside each range, written to the shared folder,
and the pieces of a key are tied together by per-range offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.operators.joins import attach
from cohortloom.session import materialise

# Largest group that is sorted inside one task, and largest whose values one aggregate holds.
MAX_GROUP_ROWS = 2_000_000
MAX_HELD_VALUES = 100_000

SortKey = str | Column


def sort_columns(order_by: Sequence[SortKey]) -> list[Column]:
    """Names become ascending sort keys with NULL last; columns are taken as they are."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order_by]


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all): two numbers, from a combined count."""
    row = (df.groupBy(*keys).agg(F.count("*").alias("n"))
           .agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first())
    return int(row["largest"] or 0), int(row["total"] or 0)


def _range_pieces(df: DataFrame, keys: Sequence[str], order_by: Sequence[SortKey], total: int,
                  limit: int) -> DataFrame:
    # Ties in the given order are spread by a row hash, so equal values do not pile up.
    sort = [F.col(k) for k in keys] + sort_columns(order_by) + [F.xxhash64(*df.columns)]
    n = max(-(-total // limit) * 2, 2)
    ranged = (df.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumns({"_piece": F.shiftright("_id", 33).cast("int"),
                            "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
              .drop("_id"))
    return materialise(ranged, "ranged")


def ordered_pieces(df: DataFrame, keys: Sequence[str], order_by: Sequence[SortKey],
                   max_group: int | None = None) -> DataFrame:
    """Add ``_piece``: pieces of a key follow each other in the given order, and each
    (key, piece) is small enough for a window."""
    limit = max_group or MAX_GROUP_ROWS
    largest, total = group_sizes(df, keys)
    if largest <= limit:
        return df.withColumn("_piece", F.lit(0))
    return _range_pieces(df, keys, order_by, total, limit).drop("_pos")


def row_index(df: DataFrame, order_by: Sequence[SortKey], partition_by: Sequence[str] = (),
              out: str = "row_index", max_group: int | None = None,
              sizes: tuple[int, int] | None = None) -> DataFrame:
    """Number rows from 1 in the given order, inside each key or over the whole frame.

    ``order_by`` should be total (end it with a unique column) for a repeatable result. A caller
    that has counted the groups passes ``sizes`` (largest group, all rows) and saves the count.
    """
    limit = max_group or MAX_GROUP_ROWS
    keys = list(partition_by) or ["_all"]
    work = df if partition_by else df.withColumn("_all", F.lit(1))
    largest, total = sizes or group_sizes(work, keys)
    if largest <= limit:
        w = W.partitionBy(*keys).orderBy(*sort_columns(order_by))
        return work.withColumn(out, F.row_number().over(w).cast("long")).select(*df.columns, out)
    pieces = _range_pieces(work, keys, order_by, total, limit)
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (pieces.groupBy(*keys, "_piece").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return (attach(pieces, starts, [*keys, "_piece"])
            .withColumn(out, (F.col("_pos") - F.col("_first") + F.col("_before") + 1).cast("long"))
            .select(*df.columns, out))


def value_places(df: DataFrame, keys: Sequence[str], value: SortKey, name: str, max_group: int | None = None) -> DataFrame:
    """(keys, value, ``_lo``, ``_hi``): every distinct value of a key holds the places _lo + 1 to _hi.

    Equal rows are counted, map-side first, before anything is ordered, so a value that most rows share is one
    row here and no range of the order is larger than the others.
    """
    counted = df.groupBy(*keys, name).agg(F.count("*").alias("_c"))
    limit = max_group or MAX_GROUP_ROWS
    counted = materialise(counted, "counted")
    largest, total = group_sizes(counted, keys)
    if largest <= limit:
        upto = W.partitionBy(*keys).orderBy(*sort_columns([value])).rowsBetween(W.unboundedPreceding, 0)
        placed = counted.withColumn("_hi", F.sum("_c").over(upto))
    else:
        pieces = _range_pieces(counted, keys, [value], total, limit).drop("_pos")
        inside = W.partitionBy(*keys, "_piece").orderBy(*sort_columns([value])).rowsBetween(W.unboundedPreceding, 0)
        earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        starts = (pieces.groupBy(*keys, "_piece").agg(F.sum("_c").alias("_n"))
                  .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
        placed = attach(pieces.withColumn("_in", F.sum("_c").over(inside)), starts, [*keys, "_piece"]).withColumn(
            "_hi", F.col("_in") + F.col("_before"))
    return placed.select(*keys, name, (F.col("_hi") - F.col("_c")).alias("_lo"), "_hi")


def rank_of(df: DataFrame, col: str, out: str, descending: bool = False, max_group: int | None = None) -> DataFrame:
    """Rank of every row over the whole frame; equal values share the smallest place, NULL is last."""
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    places = value_places(df.select(F.lit(1).alias("_all"), col), ["_all"], order, col, max_group)
    return attach(df, places.select(col, (F.col("_lo") + 1).alias(out)), col)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], max_group: int | None = None) -> DataFrame:
    """Exact quantiles per group, linear between neighbours; NULL values are left out."""
    grouped = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(1))
    src = src.select(*grouped, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if group_sizes(src, grouped)[0] <= min(MAX_HELD_VALUES, max_group or MAX_HELD_VALUES):
        out = src.groupBy(*grouped).agg(*[F.percentile("_v", F.lit(p)).alias(n)
                                          for p, n in zip(probs, names, strict=True)])
        return out.select(*keys, *names)
    places = materialise(value_places(src, grouped, "_v", "_v", max_group), "places")
    ranked = attach(places, places.groupBy(*grouped).agg(F.max("_hi").alias("_n")), grouped)
    aggs, wanted = [], F.lit(False)
    for p, name in zip(probs, names, strict=True):
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        on_low = (F.col("_lo") < lo) & (lo <= F.col("_hi"))
        on_high = (F.col("_lo") < hi) & (hi <= F.col("_hi"))
        wanted = wanted | on_low | on_high
        low = F.max(F.when(on_low, F.col("_v")))
        high = F.max(F.when(on_high, F.col("_v")))
        frac = F.max(at - F.floor(at))
        # As the aggregate of small groups does it, to the last bit.
        aggs.append(F.when(low == high, low).otherwise((1 - frac) * low + frac * high).alias(name))
    return ranked.where(wanted).groupBy(*grouped).agg(*aggs).select(*keys, *names)
