"""Merkle fixity audit of archive replicas.

Every record is hashed; records of one key are one leaf. Leaves are ordered by key and grouped into ranges of
``FANOUT`` keys, ranges into ranges, up to one root; a node's hash covers its children's numbers and hashes, so it
covers an ordered range of offsets. Two replicas are compared from the root down: only the children of nodes that
differ are looked at on the next level, so the work after hashing goes with the damage and not with the archive.

Keys are whole numbers (a record number of the index); ranges are aligned on keys, so a lost or extra record does not
shift the ranges behind it. Repeated rows of a key are hashed in a fixed order within their leaf; NULL keys share one
leaf below all others; NULL values differ from empty ones. Two empty replicas agree; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.session import materialise

FANOUT = 16
NULL_KEY = -(1 << 62)


def record_hash(*parts: Column) -> Column:
    """Hash of a record's fields, each with its length, so that fields can't run into each other."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def leaves(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(node, hash, n_bytes): one leaf per key. Only hashes and sizes leave the scan."""
    size = sum((F.coalesce(F.octet_length(f), F.lit(0)) for f in fields[1:]), F.coalesce(F.octet_length(fields[0]), F.lit(0)))
    hashed = records.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("node"),
                            record_hash(*[F.col(f) for f in fields]).alias("h"), size.cast("long").alias("n_bytes"))
    # Equal records fold into one row with a count first, so a key with many copies stays small.
    folded = hashed.groupBy("node", "h").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    return folded.groupBy("node").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))),
                                        lambda x: F.concat(x["h"], F.lit("*"), x["n"].cast("string"))), ",").cast("binary"), 256)
        .alias("hash"), F.sum("n_bytes").alias("n_bytes"))


def parents(level: DataFrame) -> DataFrame:
    """The next level up: nodes of ``FANOUT`` consecutive numbers, hashed over numbers and hashes in order."""
    up = F.floor(F.col("node") / FANOUT).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))),
                                    lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), ",")
    return level.groupBy(up.alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash"), F.sum("n_bytes").alias("n_bytes"))


def tree(records: DataFrame, key: str, fields: list[str], height: int) -> list[DataFrame]:
    """Levels of one replica from leaves to root, written once."""
    levels = [materialise(leaves(records, key, fields), "leaves")]
    for _ in range(height):
        levels.append(materialise(parents(levels[-1]), "level"))
    return levels


def height_of(*records: DataFrame, key: str) -> int:
    """Levels above the leaves after which all replicas' nodes are a single one (or one on each side of 0)."""
    far = 0
    for r in records:
        row = r.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
        far = max(far, *(abs(int(x)) for x in (row["a"], row["b"]) if x is not None), 0)
        if r.where(F.col(key).isNull()).limit(1).count():
            far = max(far, -NULL_KEY)
    height = 1
    while FANOUT ** height <= far:
        height += 1
    return height


def differing(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(node, hash, n_bytes, first_byte, other_hash, other_bytes) of the nodes that are not the same in both."""
    other = theirs.select("node", F.col("hash").alias("other_hash"), F.col("n_bytes").alias("other_bytes"))
    return (mine.join(other, "node", "full").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
            .select("node", "hash", "n_bytes", "first_byte", "other_hash", "other_bytes"))


def audit(primary: DataFrame, replica: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, list[int]]:
    """((node, problem, first_byte, n_bytes, other_bytes), nodes that differ per level from the root down).

    ``first_byte`` is where the primary's leaf starts if its records follow each other by key: the start of its
    parent plus the bytes of the siblings before it, so it is worked out along the descent.
    """
    height = height_of(primary, replica, key=key)
    mine, theirs = tree(primary, key, fields, height), tree(replica, key, fields, height)
    up, below, looked = F.floor(F.col("node") / FANOUT).cast("long"), None, []
    for a, b in zip(mine[::-1], theirs[::-1], strict=True):
        if below is None:  # the root, or one on each side of 0
            branch = a.union(b).select(up.alias("__up"), F.lit(0).cast("long").alias("__base")).distinct()
            siblings = W.partitionBy(F.lit(0)).orderBy("node")
        else:
            branch = below.select(F.col("node").alias("__up"), F.col("first_byte").alias("__base"))
            siblings = W.partitionBy("__up").orderBy("node")
        before = F.sum("n_bytes").over(siblings.rowsBetween(W.unboundedPreceding, -1))
        a = a.join(branch, up == F.col("__up")).withColumn("first_byte", F.col("__base") + F.coalesce(before, F.lit(0)))
        b = b.join(branch, up == F.col("__up"), "left_semi")
        below = materialise(differing(a, b), "differing")
        looked.append(below.count())
        if not looked[-1]:
            break
    problem = F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    found = below if len(looked) == len(mine) else below.limit(0)
    return found.select("node", problem.alias("problem"), "first_byte", "n_bytes", "other_bytes"), looked
