"""Mapping the second probe design of a methylation matrix onto the first (beta mixture quantiles).

Each sample's two designs are fitted by mixtures of three beta distributions (low, middle,
high). The fits see the counted bins of a sample and design, at most BINS of them, so no sample
is collected whole; many samples are fitted side by side. A cell is then mapped by its place on
a fixed grid: one equality join on (sample, bin) and a straight line inside the bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import tails
from cohortloom.operators.joins import attach
from cohortloom.session import materialise

BINS = 1000

# Starting borders between low, middle and high methylation; most rounds of a fit, and the change
# of a part's share in any bin that ends it.
START_BORDERS = (0.2, 0.75)
ROUNDS = 60
SETTLED = 1e-4

# Samples fitted side by side: the arrays hold at most this times 3 * BINS values.
BLOCK = 256

_MID = (np.arange(BINS) + 0.5) / BINS
_LOG_X, _LOG_Y = np.log(_MID), np.log1p(-_MID)


def _moments_to_shape(mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.clip(mean, 1e-3, 1 - 1e-3)
    var = np.clip(var, 1e-6, 0.95 * mean * (1 - mean))
    total = mean * (1 - mean) / var - 1
    return mean * total, (1 - mean) * total


def _log_parts(fits: np.ndarray, log_x: np.ndarray, log_y: np.ndarray) -> np.ndarray:
    """Log density of each part (part, row, bin) of fits (a, b, log of the factor; part, row)."""
    a, b, scale = fits[..., None]
    return scale + (a - 1) * log_x + (b - 1) * log_y


def _shares(logp: np.ndarray) -> np.ndarray:
    out = np.exp(logp - logp.max(axis=0))
    return out / out.sum(axis=0)


def fit_mixtures(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Three-part beta mixtures of binned values by expectation-maximisation with moment steps, one for each row
    of (bin, count) pairs: (a, b, log of the factor; part, row), parts by ascending mean.

    The steps need the counted bins alone. A fit ends when no share in any of all the bins moves, which
    is looked at in full once the counted ones are still.
    """
    x, lo, hi = _MID[bins], *START_BORDERS
    log_x, log_y = _LOG_X[bins], _LOG_Y[bins]
    shares = np.stack([x <= lo, (x > lo) & (x < hi), x >= hi]) * 0.98 + 0.01
    fits, rows = np.zeros((3, 3, len(bins))), np.arange(len(bins))
    for turn in range(ROUNDS):
        mass = shares * counts
        total = np.maximum(mass.sum(axis=2), 1e-9)
        mean = np.einsum("prw,rw->pr", mass, x) / total
        var = np.einsum("prw,prw->pr", mass, (x - mean[..., None]) ** 2) / total
        a, b = _moments_to_shape(mean, var)
        last, now = fits[..., rows], np.stack([a, b, np.log(total / total.sum(axis=0)) + tails.log_beta_scale(a, b)])
        fits[..., rows] = now
        new = _shares(_log_parts(now, log_x, log_y))
        going = (np.abs(new - shares).max(axis=(0, 2)) >= SETTLED) | (turn == 0)
        still = np.flatnonzero(~going)
        if len(still):
            moved = _shares(_log_parts(now[..., still], _LOG_X, _LOG_Y)) - _shares(_log_parts(last[..., still], _LOG_X, _LOG_Y))
            going[still] = np.abs(moved).max(axis=(0, 2)) >= SETTLED
        shares = new
        if not going.all():
            rows, shares, counts, x, log_x, log_y = rows[going], new[:, going], counts[going], x[going], log_x[going], log_y[going]
            if not len(rows):
                break
    order = np.argsort(fits[0] / (fits[0] + fits[1]), axis=0)
    return np.take_along_axis(fits, order[None], axis=1)


def _borders(fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last grid point of the low part and the first of the high part, going out from the component means."""
    label = _log_parts(fits, _LOG_X, _LOG_Y).argmax(axis=0)
    middle = (fits[0, 1] / (fits[0, 1] + fits[1, 1]))[:, None]
    low, high = (label == 0) & (_MID <= middle), (label == 2) & (_MID >= middle)
    # In half grid steps, as both come from the middles of bins.
    first = np.where(low.any(axis=1), 2 * (BINS - low[:, ::-1].argmax(axis=1)) - 1, 0)
    last = np.where(high.any(axis=1), 2 * high.argmax(axis=1) + 1, 2 * BINS)
    return np.minimum(first, last) // 2, (np.maximum(first, last) + 1) // 2


def mapped_points(one: np.ndarray, two: np.ndarray, row: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The mapped value of grid points 0 .. BINS of the second design, each in the fits of its row."""
    lo, hi = _borders(two)
    n, rows = len(lo), np.arange(len(lo))
    row, point = np.concatenate([rows, rows, row]), np.concatenate([lo, hi, point])
    out = np.empty(len(row))
    # The upper part is mapped by its upper tail, which keeps precision near one.
    for inside, part, (p, q), from_end in ((point <= lo[row], 0, (0, 1), point), (point >= hi[row], 2, (1, 0), BINS - point)):
        r = row[inside]
        share = tails.beta_cdf(from_end[inside] / BINS, two[p, part, r], two[q, part, r])
        value = tails.beta_quantile(share, one[p, part, r], one[q, part, r])
        out[inside] = value if part == 0 else 1 - value
    # The middle is stretched to fill what the two mapped ends leave.
    middle = (point > lo[row]) & (point < hi[row])
    r, y0, y1 = row[middle], out[:n], out[n:2 * n]
    out[middle] = y0[r] + (point[middle] - lo[r]) * (y1[r] - y0[r]) / (hi[r] - lo[r])
    # Each part ascends, so only the low one's end can lie above what follows it.
    out = np.where(point > lo[row], np.maximum(out, y0[row]), out)
    return np.clip(out[2 * n:], 0, 1)


def _padded(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Lists of several lengths as the rows of one array, zeros behind them."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), sizes.max()), flat.dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def _curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sample, bins of the first design, bins of the second) to the mapped ends of the second one's bins."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = batch.slice(start, BLOCK)
            fits = []
            for column in block.columns[1:]:
                offsets, cells = column.offsets.to_numpy(), column.values
                bins, n = cells.field("bin").to_numpy(), cells.field("n").to_numpy()
                # A fit is not changed by bins without values, so shorter lists may end in bin 0 with none.
                fits.append(fit_mixtures(_padded(offsets, bins), _padded(offsets, n)))
            row, used = np.repeat(np.arange(block.num_rows), np.diff(offsets)), bins[offsets[0]:offsets[-1]]
            y = mapped_points(*fits, np.tile(row, 2), np.concatenate([used, used + 1]))
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row)), pa.array(used), pa.array(y[:len(used)]), pa.array(y[len(used):])],
                names=[block.schema.names[0], "_bin", "y0", "y1"])


def bmiq(long: DataFrame, sample: str = "sample_id", value: str = "value", design: str = "design",
         first: str = "I", second: str = "II") -> DataFrame:
    """Replace the second design's values by mapped ones; the first design's stay, as do those of a sample without
    one of the designs and those outside 0 to 1."""
    place = F.when(F.col(value).between(0, 1), F.least(F.floor(F.col(value) * BINS), F.lit(BINS - 1)).cast("int"))
    counts = long.where(F.col(value).between(0, 1)).groupBy(sample, design, place.alias("bin")).agg(F.count("*").alias("n"))
    cell = F.struct("bin", "n")
    per_sample = counts.groupBy(sample).agg(
        F.sort_array(F.collect_list(F.when(F.col(design) == first, cell))).alias("_one"),
        F.sort_array(F.collect_list(F.when(F.col(design) == second, cell))).alias("_two"))
    # Rows are few but each costs a fit, so they are spread by number, not packed by size.
    tasks = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = per_sample.where((F.size("_one") > 0) & (F.size("_two") > 0)).repartition(tasks).mapInArrow(
        _curves, T.StructType([long.schema[sample], T.StructField("_bin", T.IntegerType()), T.StructField("y0", T.DoubleType()),
                              T.StructField("y1", T.DoubleType())]))
    # Written once: the fits are not repeated, and the join is planned from the table's true size.
    lines = materialise(lines, "curves")
    joined = attach(long.withColumn("_bin", place), lines, [sample, "_bin"])
    inside = F.col(value) * BINS - F.col("_bin")
    mapped = F.col("y0") + (F.col("y1") - F.col("y0")) * inside
    changed = F.when((F.col(design) == second) & F.col("y0").isNotNull(), mapped).otherwise(F.col(value))
    return joined.withColumn(value, changed).select(*long.columns)
