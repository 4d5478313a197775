"""Single-linkage tree of samples: the minimum spanning tree of their Euclidean distances.

Samples are points; equal ones are folded into one. Points are dealt to blocks around pivots, and blocks to shares. In
every round each component but the largest takes its lightest edge to another one (Boruvka's steps), so the number of
components at least halves. A point is only asked again when the edge it had found leads inside its component by now and
the component has none that is lighter. Lightest edges are searched in cells of two shares: blocks near each other first,
and those too far away for a lighter edge not at all.

Lengths of two blocks are first known roughly, from one product in single precision; all that may be the least within
its error are computed in full. Where points are spread so evenly that no two blocks lie apart, all are compared: that
costs the square of the number of samples in arithmetic, in tasks of two shares each, and no table of samples by samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.operators.graphs import components as linked
from cohortloom.operators.joins import attach
from cohortloom.operators.matrix import reduce as red
from cohortloom.operators.ordering import row_index
from cohortloom.session import materialise

BLOCK = 512          # points of a block, more where MAX_BLOCKS would not do
MAX_BLOCKS = 4096    # pivots that the driver holds
SHARES = 12          # parts of the points, every two of which are one task's work, more where their bytes would not do
SHARE_BYTES = 32 << 20


def lightest_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, length) of the edges of the minimum spanning tree of a few points."""
    n = len(points)
    if n < 2:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    near, far = np.zeros(n, np.int64), np.full(n, np.inf)
    inside, at = np.zeros(n, bool), 0
    first, second, length = [], [], []
    for _ in range(n - 1):
        inside[at] = True
        away = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = ~inside & (away < far)
        far[closer], near[closer] = away[closer], at
        at = int(np.where(inside, np.inf, far).argmin())
        first.append(int(near[at]))
        second.append(at)
        length.append(float(far[at]))
    return np.array(first), np.array(second), np.array(length)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _edges(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    node = table["node"].to_numpy()
    a, b, w = lightest_tree(_matrix(table))
    return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64()), "w": pa.array(w)})


def dealt(points: DataFrame, count: int, block: int) -> DataFrame:
    """The points (node, x) with ``block``: those around one pivot, split by number where they are too many."""
    size = max(block, -(-count // MAX_BLOCKS))
    pivots = points.orderBy(F.xxhash64("node"), "node").limit(max(-(-count // size), 1)).collect()  # at most MAX_BLOCKS
    centre = np.array([r["x"] for r in pivots])

    def nearest(batches):
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch]))
            cell = np.empty(len(x), np.int32)
            for start in range(0, len(x), 256):
                part = x[start:start + 256]
                cell[start:start + 256] = ((part ** 2).sum(1)[:, None] - 2 * part @ centre.T + (centre ** 2).sum(1)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("x"), pa.array(cell)], ["node", "x", "cell"])

    cells = materialise(points.select("node", "x").mapInArrow(nearest, "node long, x array<double>, cell int"), "cells")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    return cells.join(parts, "cell").select("node", "x", F.concat_ws(
        ":", "cell", F.pmod(F.xxhash64("node"), "parts")).alias("block"))


def rough_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances in single precision, by one product, and twice the most that they can be wrong."""
    base = y.mean(0)
    x, y = x - base, y - base
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left = np.concatenate([x, xx[:, None], np.ones((len(x), 1))], 1).astype(np.float32)
    right = np.concatenate([-2 * y, np.ones((len(y), 1)), yy[:, None]], 1).astype(np.float32)
    return left @ right.T, float((x.shape[1] + 8) * 2.0 ** -22 * (xx.max() + yy.max()))


def improve(found: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, node: np.ndarray, root: np.ndarray,
            rows: np.ndarray, cols: np.ndarray, square: np.ndarray, slack: float) -> None:
    """Better the lightest edge (w, a, b) found for each row by its edges to columns of other roots. Rough squares only
    choose which lengths are computed in full."""
    w, a, b = found
    some = np.flatnonzero(square.min(1) <= w[rows] ** 2 + slack)
    if not len(some):
        return
    rows, square = rows[some], square[some]
    square[root[rows][:, None] == root[cols][None, :]] = np.inf
    least = np.minimum(square.min(1).astype(float), w[rows] ** 2) + slack
    r, c = np.nonzero((square <= least[:, None]) & (square < np.inf))
    for start in range(0, len(r), 1 << 15):
        p, q = rows[r[start:start + (1 << 15)]], cols[c[start:start + (1 << 15)]]
        away = np.sqrt(((x[p] - x[q]) ** 2).sum(1))
        lo, hi = np.minimum(node[p], node[q]), np.maximum(node[p], node[q])
        order = np.lexsort((hi, lo, away, p))
        k = order[np.concatenate(([True], p[order][1:] != p[order][:-1]))]
        p, away, lo, hi = p[k], away[k], lo[k], hi[k]
        better = (away < w[p]) | ((away == w[p]) & ((lo < a[p]) | ((lo == a[p]) & (hi < b[p]))))
        p = p[better]
        w[p], a[p], b[p] = away[better], lo[better], hi[better]


def _nearest(table: pa.Table) -> pa.Table:
    """(node, w, a, b): of a cell's points that are asked for, the lightest edge to another root in the cell."""
    table = table.sort_by([("side", "ascending"), ("block", "ascending"), ("node", "ascending")]).combine_chunks()
    x = _matrix(table)
    node, root, asked, side = (table[c].to_numpy() for c in ("node", "root", "asked", "side"))
    n, own = len(node), table["i"][0] == table["j"][0]
    found = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    name = np.array(table["block"].to_pylist())
    edge = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (side[1:] != side[:-1]), [True])))
    blocks = [np.arange(s, e) for s, e in zip(edge[:-1], edge[1:], strict=True)]
    centre = np.array([x[rows].mean(0) for rows in blocks])
    radius = np.array([np.sqrt(((x[rows] - m) ** 2).sum(1)).max() for rows, m in zip(blocks, centre, strict=True)])
    first = np.flatnonzero(side[edge[:-1]] == 0)
    second = first if own else np.flatnonzero(side[edge[:-1]] == 1)
    tiles = []
    for p in first.tolist():
        q = second[second >= p] if own else second
        apart = np.sqrt(((centre[q] - centre[p]) ** 2).sum(1)) - radius[q] - radius[p]
        tiles += zip((apart * (1 - 1e-9) - 1e-9 * (radius[q] + radius[p])).tolist(), [p] * len(q), q.tolist())
    wanted = [rows[asked[rows]] for rows in blocks]
    w = found[0]
    for apart, p, q in sorted(tiles):  # near ones first, so that far ones need not be looked at
        one = wanted[p] if len(wanted[p]) and apart <= w[wanted[p]].max() else ()
        two = wanted[q] if q != p and len(wanted[q]) and apart <= w[wanted[q]].max() else ()
        if len(one) == len(blocks[p]) and len(two) == len(blocks[q]):
            square, slack = rough_squares(x[one], x[two])
            improve(found, x, node, root, one, two, square, slack)
            improve(found, x, node, root, two, one, square.T, slack)
            continue
        for rows, cols in ((one, blocks[q]), (two, blocks[p])):
            if len(rows):
                improve(found, x, node, root, rows, cols, *rough_squares(x[rows], x[cols]))
    some = np.flatnonzero(w < np.inf)
    return pa.table({"node": pa.array(node[some], pa.int64()), "w": pa.array(w[some]),
                     "a": pa.array(found[1][some], pa.int64()), "b": pa.array(found[2][some], pa.int64())})


def nearest_outside(placed: DataFrame, state: DataFrame, shares: int) -> DataFrame:
    """(node, found): the lightest edge (w, a, b) from every point that is asked for to one of another root.

    The points (node, x, block, share) are compared in cells of two shares each; ``state``: (node, root, asked).
    """
    asked = materialise(placed.join(state, "node"), "asked")
    some = [r["share"] for r in asked.where("asked").select("share").distinct().collect()]  # at most ``shares``
    met = asked.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).where(
        F.col("share").isin(some) | F.col("y").isin(some)).select(
        F.least("share", "y").alias("i"), F.greatest("share", "y").alias("j"),
        F.when(F.col("share") <= F.col("y"), 0).otherwise(1).alias("side"), "block", "node", "root", "asked", "x")
    found = met.groupBy("i", "j").applyInArrow(_nearest, "node long, w double, a long, b long")
    return found.groupBy("node").agg(F.min(F.struct("w", "a", "b")).alias("found"))


def candidate_edges(points: DataFrame, count: int, block: int = BLOCK) -> DataFrame:
    """(a, b, w), a < b: the edges of the minimum spanning tree of the points (node, x); equal lengths by a, then b."""
    folded = materialise(points.groupBy("x").agg(F.min("node").alias("node"), F.count("*").alias("n")), "folded")
    n = folded.count()
    same = points.join(folded.where("n > 1").select("x", F.col("node").alias("a")), "x").where("node > a").select(
        "a", F.col("node").alias("b"), F.lit(0.0).alias("w"))
    if n <= block:
        edges = folded.select("node", "x", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(_edges, "a long, b long, w double")
        return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").union(same)
    width = folded.select(F.size("x")).first()[0]
    most = max(block, SHARE_BYTES // (8 * width))
    shares = max(-(-n // most), min(SHARES, -(-n // (4 * block))))
    placed = materialise(dealt(folded, n, block).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")), "blocks")
    state = placed.select("node", F.col("node").alias("root"), F.lit(None).cast("struct<w:double,a:bigint,b:bigint>").alias("e"),
                          F.lit(0.0).alias("low"))
    taken = same
    while True:
        state = materialise(state, "state")
        groups = materialise(state.groupBy("root").agg(F.count("*").alias("size"), F.min("e").alias("best")), "groups")
        largest = groups.orderBy(F.desc("size"), "root").first()
        if largest["size"] == n:
            return taken
        # The largest one need not choose: every other one does, and that halves their number.
        asked = (F.col("root") != largest["root"]) & F.col("e").isNull() & (F.col("best").isNull() | (F.col("low") <= F.col("best.w")))
        asking = state.join(groups.select("root", "best"), "root").select("node", "root", asked.alias("asked"))
        found = nearest_outside(placed, asking, shares)
        state = materialise(state.join(found, "node", "left").select("node", "root", F.coalesce("found", "e").alias("e"), "low"), "state")
        light = state.where(F.col("root") != largest["root"]).groupBy("root").agg(F.min("e").alias("e")).select("e.*").distinct()
        roots = state.select("node", "root")
        light = materialise(light.join(roots.toDF("a", "ra"), "a").join(roots.toDF("b", "rb"), "b").select("a", "b", "w", "ra", "rb"), "lightest")
        taken = taken.union(light.select("a", "b", "w"))
        moved = linked(light.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "to")
        roots = materialise(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        # An edge that leads inside now only tells how long the next one is at least.
        other = F.when(F.col("e.a") == F.col("node"), F.col("e.b")).otherwise(F.col("e.a"))
        inside = F.col("e").isNotNull() & (F.col("root") == F.col("far"))
        state = state.drop("root").join(roots, "node").withColumn("_o", other).join(
            roots.toDF("_o", "far"), "_o", "left").select(
            "node", "root", F.when(~inside, F.col("e")).alias("e"), F.when(inside, F.col("e.w")).otherwise(F.col("low")).alias("low"))


def centred_points(long: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """(sample, x): every sample as its values less the features' means, for at most ``reduce.MAX_SIDE`` features."""
    cells = red.centred_cells(long, feature, sample, value)
    ids = [row[0] for row in cells.select(feature).distinct().orderBy(feature).collect()]
    place = cells.sparkSession.createDataFrame([(v, i) for i, v in enumerate(ids)],
                                               T.StructType([cells.schema[feature], T.StructField("_at", T.IntegerType())]))
    lists = attach(cells, F.broadcast(place), feature, "inner").groupBy(sample).agg(
        F.collect_list(F.struct("_at", "_x")).alias("cells"))

    def dense(batches):
        for batch in batches:
            cells = batch.column("cells")
            flat = cells.flatten()
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            x = np.zeros((len(cells), len(ids)))
            np.add.at(x, (row, flat.field("_at").to_numpy(zero_copy_only=False)), flat.field("_x").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(sample), pa.array(list(x), pa.list_(pa.float64()))], [sample, "x"])

    return lists.mapInArrow(dense, T.StructType([cells.schema[sample], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def sample_tree(long: DataFrame, feature: str = "feature_id", sample: str = "sample_id", value: str = "value",
                leading: int | None = None, block: int = BLOCK) -> DataFrame:
    """(step, sample_a, sample_b, height): one row per merge, n - 1 for n samples, by height.

    Two clusters merge at the least distance of their members, that of sample_a and sample_b, the one with the smaller
    id first; equal heights come by ids. ``leading`` takes that many components only, which is needed where samples and
    features are both more than ``reduce.MAX_SIDE``. A missing cell counts as its feature's mean.
    """
    sides = long.agg(F.count_distinct(feature).alias("d"), F.count_distinct(sample).alias("n")).first()
    small = min(sides["d"], sides["n"])
    if leading is None and small > red.MAX_SIDE:
        raise ValueError(f"more than {red.MAX_SIDE} samples and features: choose how many leading components count")
    if leading is None and sides["d"] <= red.MAX_SIDE:
        points = centred_points(long, feature, sample, value)
    else:
        points = red.components(long, leading or max(small, 1), feature, sample, value).withColumnRenamed("_b", "x")
    numbered = materialise(row_index(points, [sample], out="node"), "points")
    forest = materialise(candidate_edges(numbered, sides["n"], block), "tree")
    name = lambda df, end: attach(df, numbered.select(F.col("node").alias(end), F.col(sample).alias(f"sample_{end}")), end)
    return row_index(forest, ["w", "a", "b"], out="step").transform(lambda df: name(name(df, "a"), "b")).select(
        "step", "sample_a", "sample_b", F.col("w").alias("height"))


def cut_tree(tree: DataFrame, k: int) -> DataFrame:
    """(sample, cluster): the k clusters that are left when all but the last k - 1 merges are done; a cluster is called
    by its smallest sample."""
    merges = materialise(tree, "merges")
    last = merges.count() - k + 1
    every = merges.select(F.explode(F.array("sample_a", "sample_b")).alias("a")).select("a", F.col("a").alias("b"))
    done = merges.where(F.col("step") <= last).select(F.col("sample_a").alias("a"), F.col("sample_b").alias("b"))
    return linked(every.union(done)).select(F.col("node").alias("sample"), F.col("root").alias("cluster"))
