"""Joins with null-safe keys: NULL meets NULL, as cohort tables need.

Right sides that are only tested for membership are reduced to distinct keys before they are
shuffled. The null-safe condition also makes both sides exchange on the same expressions, so
adaptive execution can split a hot key of the left side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import common_columns
from cohortloom.operators.substrings import containing
from cohortloom.session import materialise

_RIGHT = "_right_"

# Most bytes of region bins that are sent whole to every executor.
MAX_BROADCAST_BYTES = 32 << 20


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _condition(left: Sequence[str], right: Sequence[str], nulls: str):
    if nulls not in ("match", "never"):
        raise ValueError("nulls must be 'match' or 'never'")
    pairs = [(F.col(l), F.col(r)) for l, r in zip(left, right, strict=True)]
    return reduce(and_, [a.eqNullSafe(b) if nulls == "match" else a == b for a, b in pairs])


def attach(df: DataFrame, other: DataFrame, keys: str | Sequence[str], how: str = "left",
           nulls: str = "match", other_keys: str | Sequence[str] | None = None) -> DataFrame:
    """Join ``other`` on its keys and keep the left key columns once."""
    left = _keys(keys)
    right = _keys(other_keys) if other_keys is not None else left
    renamed = other.withColumnsRenamed({k: _RIGHT + k for k in right})
    joined = df.join(renamed, _condition(left, [_RIGHT + k for k in right], nulls), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[_RIGHT + k for k in right])


def join_on(a: DataFrame, b: DataFrame, key: str | Sequence[str], how: str = "inner",
            suffixes: tuple[str, str] = ("_x", "_y"), nulls: str = "match") -> DataFrame:
    """Join on named keys; other names found on both sides get a suffix."""
    keys = _keys(key)
    clash = [c for c in common_columns(a, b) if c not in keys]
    return attach(a.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
                  b.withColumnsRenamed({c: c + suffixes[1] for c in clash}), keys, how, nulls)


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner", nulls: str = "match") -> DataFrame:
    """Join on every shared column name (``how``: inner or left)."""
    shared = common_columns(a, b)
    if not shared:
        raise ValueError("the frames share no column")
    return attach(a, b, shared, how, nulls)


def join_many(dfs: Sequence[DataFrame], how: str = "left", nulls: str = "match") -> DataFrame:
    """Fold a list of frames with natural joins, first frame leftmost."""
    return reduce(lambda a, b: natural_join(a, b, how, nulls), dfs)


def _distinct_keys(b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return b.select(*keys).distinct()


def keep_in(a: DataFrame, b: DataFrame, key: str | Sequence[str],
            other_key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of ``a`` whose key occurs in ``b``; NULL counts as a value."""
    right = _keys(other_key) if other_key is not None else _keys(key)
    return attach(a, _distinct_keys(b, right), key, "left_semi", other_keys=right)


def drop_in(a: DataFrame, *others: DataFrame, key: str | Sequence[str],
            other_key: str | Sequence[str] | None = None) -> DataFrame:
    """Rows of ``a`` whose key occurs in none of the others. A NULL key stays unless another
    frame has a NULL key, unlike SQL NOT IN."""
    right = _keys(other_key) if other_key is not None else _keys(key)
    return reduce(lambda left, b: attach(left, _distinct_keys(b, right), key, "left_anti", other_keys=right),
                  others, a)


def match_report(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Every distinct key of either side with ``match_status``: both, left_only or right_only."""
    keys = _keys(key)
    left = _distinct_keys(a, keys).withColumn("_in_a", F.lit(True))
    right = _distinct_keys(b, keys).withColumn("_in_b", F.lit(True))
    # One tagged union and one combined count per key does the full outer match in one shuffle.
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("_in_a").alias("_in_a"), F.max("_in_b").alias("_in_b"))
    status = (F.when(F.col("_in_a") & F.col("_in_b"), "both")
              .when(F.col("_in_a"), "left_only").otherwise("right_only"))
    return both.select(*keys, status.alias("match_status"))


def match_substring(a: DataFrame, b: DataFrame, col: str, key: str, exact: bool = True) -> DataFrame:
    """Rows of ``a`` whose text equals (``exact``) or contains some key of ``b``."""
    if exact:
        return keep_in(a, b.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()), col, "_key")
    return containing(a, col, b, key)


def lookup_first(a: DataFrame, b: DataFrame, key: str, position: str, out: str = "first_position") -> DataFrame:
    """Add the smallest position at which the key occurs in ``b``; NULL where it is not found."""
    firsts = b.groupBy(key).agg(F.min(position).alias(out))
    return attach(a, firsts, key)


def fill_from_lookup(a: DataFrame, b: DataFrame, key: str, col: str, drop_unmatched: bool = False) -> DataFrame:
    """Rows without a value take it from ``b`` by key. ``drop_unmatched`` drops the rows that get none."""
    other = b.select(F.col(key).alias("_key"), F.col(col).alias("_value")).where(F.col("_value").isNotNull())
    joined = a.join(other, F.col(key).eqNullSafe(F.col("_key")) & F.col(col).isNull(), "left")
    filled = joined.withColumn(col, F.coalesce(F.col(col), F.col("_value"))).select(*a.columns)
    return filled.where(F.col(col).isNotNull()) if drop_unmatched else filled


def cohort_status(a: DataFrame, sources: Mapping[str, DataFrame], key: str, out: str = "status",
                  otherwise: str = "Unknown") -> DataFrame:
    """Label every row with the first source that has its key, or ``otherwise``: a partition of
    ``a`` whose parts can be filtered out for audit."""
    labels = list(sources)
    tagged = [sources[name].select(key).distinct().withColumn("_rank", F.lit(i)) for i, name in enumerate(labels)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min("_rank").alias("_rank"))
    label = F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("_rank") + 1)
    return (attach(a, best, key)
            .withColumn(out, F.when(F.col("_rank").isNull(), otherwise).otherwise(label)).drop("_rank"))


def label_or(a: DataFrame, b: DataFrame, key: str, col: str, otherwise: object) -> DataFrame:
    """Take ``col`` from ``b`` (unique keys) or the given default where the key is not there."""
    label = b.select(key, F.col(col).alias("_label"), F.lit(True).alias("_found"))
    return (attach(a, label, key)
            .withColumn(col, F.when(F.col("_found"), F.col("_label")).otherwise(F.lit(otherwise)))
            .drop("_label", "_found"))


def zip_join(a: DataFrame, b: DataFrame, key: str, order_a: Sequence[str], order_b: Sequence[str],
             gate: bool = True, place: str = "k") -> DataFrame:
    """Per key, the k-th row of ``a`` meets the k-th row of ``b``; with ``gate`` only for keys whose
    two counts agree. ``place`` names the column that holds the k."""
    from cohortloom.operators.ordering import row_index

    left, right, sizes = a, b, None
    if gate:
        counts_a = a.groupBy(key).agg(F.count("*").alias("_na"))
        counts_b = b.groupBy(key).agg(F.count("*").alias("_nb"))
        equal = materialise(attach(counts_a, counts_b, key, "inner").where("_na = _nb"), "equal")
        top = equal.agg(F.max("_na").alias("largest"), F.sum("_na").alias("total")).first()
        sizes = (top["largest"] or 0, top["total"] or 0)
        left, right = keep_in(a, equal, key), keep_in(b, equal, key)
    left = row_index(left, order_a, [key], place, sizes=sizes)
    right = row_index(right, order_b, [key], place, sizes=sizes)
    return attach(left, right, [key, place], "inner")


def region_join(sites: DataFrame, regions: DataFrame, how: str = "inner") -> DataFrame:
    """Every (site, region) with ``start <= pos <= end`` on the same chrom; ``how``: inner, or left to keep all sites.

    A region's class is the power of two from its width up, and it lies in at most two cells of that width, however wide
    it is: so a region is two rows at most, and a site looks up its one cell of every class that is in use (63 at most).
    Both meet by (chrom, class, cell), and the range test is a filter that passes one candidate in four or more where
    sites are evenly spread. The listed regions' size in bytes decides between a broadcast and a shuffle.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    place = lambda c: F.floor(c).cast("long")
    span = place("end") - place("start") + 1
    sized = regions.where("start <= end").withColumnRenamed("chrom", "_chrom").withColumn(
        "_class", F.when(span > 1, F.length(F.bin(span - 1))).otherwise(0))
    cells = sized.withColumn("_cell", F.explode(F.expr(
        "sequence(shiftright(cast(floor(start) as bigint), _class), shiftright(cast(floor(end) as bigint), _class))")))
    width = F.octet_length(F.to_json(F.struct(*regions.columns))) + 32
    facts = regions.select(width.alias("w")).agg(F.sum("w").alias("w")).first()
    classes = [row[0] for row in sized.select("_class").distinct().orderBy("_class").collect()]
    cells = F.broadcast(cells) if 2 * (facts["w"] or 0) <= MAX_BROADCAST_BYTES else cells.hint("shuffle_merge")
    # For a left join every different position meets the regions once, and sites without any come back by position.
    left = sites if how == "inner" else sites.select("chrom", "pos").distinct()
    seen = left.withColumn("_site_class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).withColumn(
        "_site_cell", F.expr("shiftright(cast(floor(pos) as bigint), _site_class)"))
    cond = ((F.col("chrom") == F.col("_chrom")) & (F.col("_site_class") == F.col("_class")) & (F.col("_site_cell") == F.col("_cell"))
            & F.col("pos").between(F.col("start"), F.col("end")))
    met = seen.join(cells, cond).drop("_chrom", "_class", "_cell", "_site_class", "_site_cell")
    return met if how == "inner" else attach(sites, met, ["chrom", "pos"])
