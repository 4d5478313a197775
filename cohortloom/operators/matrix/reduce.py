"""Feature selection, components, clustering and differential features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import tails
from cohortloom.operators.joins import attach
from cohortloom.operators.ordering import exact_quantiles
from cohortloom.operators.ranking import top_n
from cohortloom.session import materialise

# Fixed value: scales the median absolute deviation to the normal standard deviation.
MAD_SCALE = 1.4826

MAX_SIDE = 2048          # samples or features, whichever are fewer, whose square matrix (32 MB) the driver may hold
EXTRA_DIRECTIONS = 8     # columns of the power iteration's block beyond the wanted components
POWER_ROUNDS, POWER_TOLERANCE = 300, 1e-12


def mad(long: DataFrame, feature: str = "feature_id", value: str = "value", out: str = "mad") -> DataFrame:
    """Scaled median absolute deviation per feature, exact, in two quantile passes."""
    med = exact_quantiles(long, [feature], value, [0.5], ["_m"])
    dev = attach(long, med, feature).select(feature, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    spread = exact_quantiles(dev, [feature], "_d", [0.5], [out])
    return spread.withColumn(out, F.col(out) * MAD_SCALE)


def top_mad(long: DataFrame, n: int, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """The n features that vary most."""
    return top_n(mad(long, feature, value), "mad", n, [feature])


def centred_cells(long: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """(feature, sample, ``_x``): every cell less its feature's mean, written. A missing cell is left out, so it counts
    as that mean; a sample without any value is an error, and none is left out."""
    cells = long.select(feature, sample, F.col(value).cast("double").alias("_v"))
    empty = cells.groupBy(sample).agg(F.count("_v").alias("n")).where("n = 0").select(sample).limit(10).collect()
    if empty:
        raise ValueError(f"samples without values: {[row[0] for row in empty]}")
    cells = cells.where("_v is not null")
    means = cells.groupBy(feature).agg(F.avg("_v").alias("_m"))
    return materialise(attach(cells, means, feature).select(feature, sample, (F.col("_v") - F.col("_m")).alias("_x")), "centred")


def gram(cells: DataFrame, many: str, few: str) -> tuple[list, np.ndarray]:
    """The ids of the side ``few`` in order and its matrix of sums of products over the side ``many``.

    Every row of ``many`` is one vector over the ids of ``few``; tasks add up their vectors' products, so any number
    of rows is summed in parallel. The driver holds the square of the number of ids.
    """
    ids = [row[0] for row in cells.select(few).distinct().orderBy(few).collect()]
    n = len(ids)
    place = cells.sparkSession.createDataFrame([(v, i) for i, v in enumerate(ids)],
                                               T.StructType([cells.schema[few], T.StructField("_at", T.IntegerType())]))
    rows = attach(cells, place, few, "inner").groupBy(many).agg(F.collect_list(F.struct("_at", "_x")).alias("cells"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((n, n))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds the dense block
                lists = batch.column("cells").slice(start, 256)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                x = np.zeros((len(lists), n))
                x[row, flat.field("_at").to_numpy(zero_copy_only=False)] = flat.field("_x").to_numpy(zero_copy_only=False)
                product += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(product), pa.list_(pa.float64()))],
                                         ["i", "product"])

    parts = rows.select("cells").mapInArrow(add, "i int, product array<double>")
    total = F.aggregate(F.collect_list("product"), F.array_repeat(F.lit(0.0), n), lambda a, x: F.zip_with(a, x, lambda u, w: u + w))
    sums = parts.groupBy("i").agg(total.alias("product")).orderBy("i").collect()
    product = np.array([r["product"] for r in sums]).reshape(n, n)
    return ids, (product + product.T) / 2


def _leading(products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues and their vectors."""
    values, vectors = np.linalg.eigh(products)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), vectors[:, order]


def _times(cells: DataFrame, block: DataFrame, over: str, to: str, k: int) -> DataFrame:
    """(to, ``_b``): the cells' matrix times a thin block (over, ``_b``), by a join and k sums."""
    joined = cells.join(block, over)
    sums = joined.groupBy(to).agg(*[F.sum(F.col("_x") * F.col("_b")[j]).alias(f"s{j}") for j in range(k)])
    return sums.select(to, F.array(*[f"s{j}" for j in range(k)]).alias("_b"))


def _block_gram(block: DataFrame, k: int) -> np.ndarray:
    """k x k sums of products of a block's columns."""
    row = block.agg(*[F.sum(F.col("_b")[i] * F.col("_b")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def _numbers(values: Sequence[float]) -> Column:
    """A constant array of doubles."""
    return F.expr(f"array({', '.join(f'double({float(v)!r})' for v in values)})")


def _turned(block: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """A block times a small matrix, row by row."""
    def product(j):
        return F.aggregate(F.zip_with("_b", _numbers(matrix[:, j]), lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)

    return block.select(key, F.array(*[product(j) for j in range(matrix.shape[1])]).alias("_b"))


def block_power(cells: DataFrame, k: int, feature: str, sample: str) -> DataFrame:
    """(sample, ``_b``): scores on the first k components where both sides are many.

    A block of k and a few more random directions of features is multiplied by the matrix and its transpose, made
    orthonormal through its own small product matrix, and so on until the greatest values stand still; a block that
    does not get there in ``POWER_ROUNDS`` is an error. Only numbers of the block's width squared reach the driver.
    """
    width, before = k + EXTRA_DIRECTIONS, None
    start = cells.select(feature).distinct().select(feature, F.transform(
        F.sequence(F.lit(1), F.lit(width)), lambda j: F.xxhash64(F.col(feature), j) / F.lit(2.0 ** 63)).alias("_b"))
    block = materialise(start, "block")
    for _ in range(POWER_ROUNDS):
        values, vectors = np.linalg.eigh(_block_gram(block, width))
        some = values > values.max(initial=0.0) * 1e-14
        if not some.any():
            break
        whiten = vectors[:, some] / np.sqrt(values[some])
        block, width = _turned(block, feature, whiten), int(some.sum())
        scores = materialise(_times(cells, block, feature, sample, width), "scores")
        size, turn = _leading(_block_gram(scores, width), width)
        now = size[:k]
        if before is not None and len(before) == len(now) and np.abs(now - before).max(initial=0) <= POWER_TOLERANCE * now.max(initial=0.0):
            return _turned(scores, sample, turn[:, :k])
        before = now
        block = materialise(_times(cells, scores, sample, feature, width), "block")
    else:
        raise ValueError(f"the components did not settle in {POWER_ROUNDS} rounds")
    return cells.select(sample).distinct().select(sample, F.array(*[F.lit(0.0)] * k).alias("_b"))


def components(long: DataFrame, k: int, feature: str = "feature_id", sample: str = "sample_id", value: str = "value",
               max_side: int | None = None) -> DataFrame:
    """(sample, ``_b``): scores of all samples on the first k components of centred features, for any number of both.

    Where one side has at most ``MAX_SIDE`` ids, its square matrix of products gives exact components: of features, then
    every sample is projected in one distributed pass, or of samples, whose scores it holds itself. Otherwise
    ``block_power`` multiplies the matrix with a thin block. There is no table of samples by samples beyond that bound.
    Signs: the greatest score of a component is positive.
    """
    limit = MAX_SIDE if max_side is None else max_side
    cells = centred_cells(long, feature, sample, value)
    sides = cells.agg(F.count_distinct(feature).alias("d"), F.count_distinct(sample).alias("n")).first()
    k = min(k, sides["d"], sides["n"])
    if k == 0:
        return cells.select(sample, F.array().cast("array<double>").alias("_b")).limit(0)
    if min(sides["d"], sides["n"]) > limit:
        scores = block_power(cells, k, feature, sample)
    elif sides["d"] <= sides["n"]:
        ids, products = gram(cells, sample, feature)
        _, vectors = _leading(products, k)
        loadings = cells.sparkSession.createDataFrame(
            [(i, list(map(float, v))) for i, v in zip(ids, vectors, strict=True)],
            T.StructType([cells.schema[feature], T.StructField("_b", T.ArrayType(T.DoubleType()))]))
        scores = _times(cells, F.broadcast(loadings), feature, sample, k)  # at most MAX_SIDE rows
    else:
        ids, products = gram(cells, feature, sample)
        values, vectors = _leading(products, k)
        scores = cells.sparkSession.createDataFrame(
            [(i, list(map(float, v))) for i, v in zip(ids, vectors * np.sqrt(values), strict=True)],
            T.StructType([cells.schema[sample], T.StructField("_b", T.ArrayType(T.DoubleType()))]))
    scores = materialise(scores, "scores")
    far = scores.agg(*[F.max(F.struct(F.abs(F.col("_b")[j]), F.col("_b")[j].alias("s"))).alias(f"f{j}") for j in range(k)]).first()
    signs = _numbers([-1.0 if far[f"f{j}"]["s"] < 0 else 1.0 for j in range(k)])
    return scores.select(sample, F.zip_with("_b", signs, lambda x, s: x * s).alias("_b"))


def _named(scores: DataFrame, sample: str, k: int, prefix: str) -> DataFrame:
    first = scores.select(F.size("_b").alias("n")).first()
    width = first["n"] if first else k
    return scores.select(sample, *[F.col("_b")[j].alias(f"{prefix}{j + 1}") for j in range(width)])


def pca(long: DataFrame, k: int, feature: str = "feature_id", sample: str = "sample_id", value: str = "value",
        max_side: int | None = None) -> DataFrame:
    """(sample, pc1, ...): scores of all samples on the first k ``components``."""
    return _named(components(long, k, feature, sample, value, max_side), sample, k, "pc")


def mds(long: DataFrame, k: int = 2, feature: str = "feature_id", sample: str = "sample_id", value: str = "value",
        max_side: int | None = None) -> DataFrame:
    """(sample, dim1, ...): classical scaling of the Euclidean distances between samples to k dimensions. Centring the
    features centres the samples' products too, so the coordinates are the scores on the first components."""
    return _named(components(long, k, feature, sample, value, max_side), sample, k, "dim")


def pc_association(scores: DataFrame, pheno: DataFrame, columns: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """F test of every component against every sample column (batch, sex, age ...): one table with
    component, term, df, sumsq, meansq, statistic, p_value. Samples without the column's value are left out of its tests.

    All components and columns are one exploded table, so two combined aggregations give every test. Text columns are
    factors, all others slopes; a column without two levels, or without spread, has no test.
    """
    types, names = dict(pheno.dtypes), [c for c in scores.columns if c != sample]
    factors, slopes = [c for c in columns if types[c] == "string"], [c for c in columns if types[c] != "string"]
    means = pheno.agg(F.lit(0), *[F.avg(c).alias(c) for c in slopes]).first()
    tagged = lambda of, kind, make: F.array(*[
        F.struct(F.lit(c).alias("term"), make(c).alias(kind)) for c in of])
    joined = attach(scores, pheno.select(sample, *columns), sample, "inner").select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("y")) for c in names])).alias("s"), *columns)
    tables = []
    if factors:
        cells = joined.select("s.*", F.explode(tagged(factors, "level", F.col)).alias("t")).select("component", "y", "t.*").dropna()
        levels = cells.groupBy("component", "term", "level").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.var_pop("y").alias("v"))
        total = levels.groupBy("component", "term").agg(
            F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
            F.sum("s").alias("s"), F.sum(F.col("n") * F.col("v")).alias("rss"))
        tables.append(total.select("component", "term", (F.col("k") - 1).alias("df"), (F.col("n") - F.col("k")).alias("rest"),
                                   (F.col("b") - F.col("s") * F.col("s") / F.col("n")).alias("sumsq"), "rss"))
    if slopes:
        centred = lambda c: F.col(c).cast("double") - float(means[c] or 0.0)
        cells = joined.select("s.*", F.explode(tagged(slopes, "x", centred)).alias("t")).select("component", "y", "t.*").dropna()
        sums = cells.groupBy("component", "term").agg(
            F.count("*").alias("n"), (F.covar_pop("x", "y") * F.count("*")).alias("xy"),
            (F.var_pop("x") * F.count("*")).alias("xx"), (F.var_pop("y") * F.count("*")).alias("yy"))
        part = F.when(F.col("xx") > 0, F.col("xy") * F.col("xy") / F.col("xx"))
        tables.append(sums.select("component", "term", F.lit(1).cast("long").alias("df"), (F.col("n") - 2).alias("rest"),
                                  part.alias("sumsq"), (F.col("yy") - part).alias("rss")))
    out = reduce(DataFrame.unionByName, tables)

    @F.pandas_udf("double")
    def tail(f: pd.Series, df: pd.Series, rest: pd.Series) -> pd.Series:
        return pd.Series(tails.f_sf(f.to_numpy(float), df.to_numpy(float), rest.to_numpy(float)), index=f.index)

    tested = out.withColumn("meansq", F.when(F.col("df") > 0, F.col("sumsq") / F.col("df"))).withColumn(
        "statistic", F.when((F.col("rest") > 0) & (F.col("rss") > 0), F.col("meansq") / (F.col("rss") / F.col("rest"))))
    p = F.when(F.col("statistic").isNotNull(), tail(F.coalesce("statistic", F.lit(0.0)), F.greatest("df", F.lit(1)).cast("double"),
                                                    F.greatest("rest", F.lit(1)).cast("double")))
    return tested.select("component", "term", "df", "sumsq", "meansq", "statistic", p.alias("p_value"))


def cluster_samples(long: DataFrame, k: int, seed: int = 1, feature: str = "feature_id", sample: str = "sample_id",
                    value: str = "value", leading: int = 10) -> DataFrame:
    """Top-down clustering of all samples into k groups, on their scores on the ``leading`` components.

    Scores lie around 0, where the two halves of a cluster would start at the same point (they start apart by a share
    of the centre's length), so all are moved by the greatest score, which keeps distances.
    """
    scores = components(long, leading, feature, sample, value)
    far = scores.agg(F.max(F.array_max(F.transform("_b", F.abs)))).first()[0] or 0.0
    points = scores.select(sample, array_to_vector(F.transform("_b", lambda x: x + F.lit(float(far)))).alias("features"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    return model.transform(points).select(sample, "cluster")


def group_means(long: DataFrame, in_first: Column, feature: str = "feature_id", value: str = "value",
                offset: float = 0.01) -> DataFrame:
    """Per feature: mean of each of two groups, their difference and log2 quotient (the offset keeps
    the quotient defined at zero; it is NULL where a shifted mean is not positive)."""
    out = long.groupBy(feature).agg(F.avg(F.when(in_first, F.col(value))).alias("mean_g1"),
                                    F.avg(F.when(~in_first, F.col(value))).alias("mean_g2"))
    a, b = F.col("mean_g1") + offset, F.col("mean_g2") + offset
    return out.withColumns({"mean_diff": F.col("mean_g1") - F.col("mean_g2"),
                            "quot_log2": F.when((a > 0) & (b > 0), F.log2(a / b))})
