"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a key hash. A bucket is split on its next bit only if its bytes
exceed the limit, until every shard fits. Sizes are first added up per cell (a hash prefix a few bits finer than
the number of shards asks for); cells that are still too large are cut further from their own rows. Only ids,
hashes and sizes move; texts stay where they are until shards are written.

Rows that share one key can't be told apart by its hash. When all bits are used up and a bucket is still too large,
its rows are dealt to overflow pages in row order, each within the limit. A row above the limit is a shard of its
own. NULL keys are one key. NULL texts weigh nothing. Repeated rows each take their place. An empty table gives no
shards; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ordering import row_index
from cohortloom.session import materialise

BITS = 60            # hash bits in use
EXTRA_BITS = 6       # of a cell, beyond those that evenly filled shards need
STEP_BITS = 10       # by which cells that are still too large grow
LIMIT_BYTES = 4 << 20


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's md5, so that any engine can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(of: Column, depth) -> Column:
    """The leading bits of a hash as a text of 0 and 1: the name of the bucket at this depth."""
    return F.substring(F.lpad(F.bin(of), BITS, "0"), F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, n_docs): the buckets that are not split, from (hash, bytes) rows.

    A bucket exists if all buckets above it are too large; it is a shard if it fits or has no bits left.
    """
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(int(math.log2(max(total / limit, 1))) + EXTRA_BITS, 1))
    open_rows, shards = rows, None
    while True:
        cells = open_rows.groupBy(prefix(F.col("hash"), high).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        levels = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        sums = cells.select("bytes", "n", "cell", levels).groupBy(
            F.substring("cell", F.lit(1), F.col("depth")).alias("shard"), "depth").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_docs"))
        sums = materialise(sums, "buckets")
        large = sums.where(F.col("shard_bytes") > limit).select(F.col("shard").alias("p"))
        above = F.substring("shard", F.lit(1), F.length("shard") - 1)
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        here = fits.where(F.col("depth") > low).join(large, above == F.col("p"), "left_semi")
        here = here.unionByName(fits.where(F.col("depth") == low)) if low == 0 else here
        shards = here if shards is None else shards.unionByName(here)
        rest = materialise(sums.where((F.col("depth") == high) & (F.col("shard_bytes") > limit) & (F.col("depth") < BITS))
                           .select("shard"), "large")
        if rest.isEmpty():
            return shards
        open_rows = materialise(open_rows.join(rest, prefix(F.col("hash"), high) == F.col("shard"), "left_semi"), "open")
        low, high = high, min(BITS, high + STEP_BITS)


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shard, depth, page, n_bytes, shard_bytes, n_docs) for every row.

    ``page`` is 0 but for rows that share a bucket without bits left; ``shard_bytes`` and ``n_docs`` count all pages.
    """
    rows = materialise(docs.select(docs[key].alias("key"), key_hash(docs[key]).alias("hash"), F.lit(0).cast("long").alias("row"),
                                   F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("bytes")), "rows")
    columns = [F.col("key").alias(key), "shard", "depth", "page", F.col("bytes").alias("n_bytes"), "shard_bytes", "n_docs"]
    return placed(rows, limit).select(*columns)


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """Written rows (key, hash, row, bytes) with shard, depth, page, shard_bytes and n_docs."""
    shards = materialise(directory(rows, limit), "shards")
    depths = [r["depth"] for r in shards.select("depth").distinct().collect()]  # at most 61 numbers
    # Each row meets the one bucket that holds it: its hash is cut at every depth in use.
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), prefix(F.col("hash"), d).alias("p")) for d in sorted(depths)] or [
        F.struct(F.lit(0).alias("d"), F.lit("").alias("p"))])).alias("x")
    full = shards.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit)).select("shard")
    found = materialise(
        rows.select("key", "row", "bytes", at).select("key", "row", "bytes", F.col("x.p").alias("shard"), F.col("x.d").alias("depth"))
        .join(shards, ["shard", "depth"]), "placed")
    first = found.withColumn("page", F.lit(0).cast("long"))
    if full.isEmpty():
        return first
    paged = pages(found.join(full, "shard", "left_semi"), limit)
    return first.join(full, "shard", "left_anti").unionByName(paged.select(*first.columns))


def pages(over: DataFrame, limit: int) -> DataFrame:
    """Deal the rows of one-key buckets to pages by equal numbers of rows, few enough for the largest row."""
    largest = over.groupBy("shard").agg(F.max("bytes").alias("largest"))
    numbered = row_index(over, ["bytes", "key", "row"], partition_by=["shard"], out="place")
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("largest", F.lit(1))), F.lit(1))
    return numbered.join(largest, "shard").withColumn("page", F.floor((F.col("place") - 1) / per_page))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents as one folder per shard and page, each row exactly once, whatever its key is.

    Rows are numbered as they are written to the shared folder, and meet their shard by that number: repeated and NULL
    keys are neither lost nor multiplied. Columns called like the folders are an error.
    """
    if clash := {"shard", "page"} & set(docs.columns):
        raise ValueError(f"columns named like the folders: {sorted(clash)}")
    rows = materialise(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
                                   F.monotonically_increasing_id().alias("row")), "documents")
    of_key, size = F.col("doc")[key], F.coalesce(F.octet_length(F.col("doc")[text]), F.lit(0)).cast("long")
    sized = materialise(rows.select(of_key.alias("key"), key_hash(of_key).alias("hash"), "row", size.alias("bytes")), "rows")
    found = rows.join(placed(sized, limit).select("row", "shard", "page"), "row")
    found.repartition("shard", "page").select("doc.*", "shard", "page").write.partitionBy("shard", "page").parquet(path)
