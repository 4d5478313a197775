"""Merkle manifest of a dataset: one hash tree per group of records, and one over the groups.

Records are leaves, ordered inside their group by key; every ``FANOUT`` consecutive nodes make one node of the next
level until one is left, the group's subroot; subroots, ordered by group, make the root in the same way. A level is
built by a slot pivot: one conditional aggregate per slot spreads the children of a parent into ``FANOUT`` columns.
The columns in order give the parent's hash, and the columns without a child's own slot are its siblings.

Places in the order come from range partitions that are sorted, written and tied together by one count per range, so a
group that holds most records lies in as many tasks as its size asks for. Records never travel, only their hashes do.
Proofs go from the root down: a node hands the siblings above it to its children, so what is shuffled per record is a
sixteenth of a proof, and proofs are hashed and folded where they are put together.

NULL fields differ from empty ones. Groups come in bytewise order, NULL first; so do keys inside them, and records that
share a key are ordered by their hash, so equal records are interchangeable. A single record is its own subroot and a
single group's subroot the root. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.session import materialise

FANOUT = 16
SLOTS = [f"c{s}" for s in range(FANOUT)]
PATH = "array<struct<l:string,r:string>>"
RESULTS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of texts one after the other."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf_hash(*fields: Column) -> Column:
    """Hash of a record: each field with its length in bytes, ``-`` where it is NULL."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, written, with ``at``, their place in the given order from 0, and ``part``, the range they lie in."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(ranged.withColumn("__id", F.monotonically_increasing_id()), name).withColumn(
        "part", F.shiftright("__id", 33))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = written.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # one row per range
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(starts, "part").select(*rows.columns, "part", (inside + F.col("before")).alias("at"))


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``g``, ``n``, ``i``: group number, its size and the place in it; groups as (g, n)).

    ``leaves``: (grp, key, leaf, ...). Groups are looked up per range, so a large one is met by many tasks.
    """
    placed = positions(leaves, ["grp", "key", "leaf"], "leaves")
    runs = materialise(placed.groupBy("part", "grp").agg(F.min("at").alias("at"), F.count("*").alias("n")), "runs")
    of_group = runs.groupBy("grp").agg(F.min("at").alias("first"), F.sum("n").alias("n"))
    groups = materialise(positions(of_group, ["first"], "groups").select("grp", "first", "n", F.col("at").alias("g")), "groups")
    where = runs.select("part", F.col("grp").alias("__grp")).join(groups, F.col("__grp").eqNullSafe(F.col("grp"))).select(
        F.col("part").alias("__part"), "__grp", "g", "n", "first")
    out = placed.join(where, (F.col("part") == F.col("__part")) & F.col("grp").eqNullSafe(F.col("__grp")))
    kept = [c for c in leaves.columns if c != "grp"]
    return out.select("g", "n", (F.col("at") - F.col("first")).alias("i"), *kept), groups.select("g", "n")


def pivot(nodes: DataFrame) -> DataFrame:
    """(g, n, i, c0 ... c15) of the parents: their children spread over the slots, by number; ``n`` counts the parents."""
    slot = F.col("i") % FANOUT
    return nodes.groupBy("g", F.ceil(F.col("n") / FANOUT).alias("n"), F.floor(F.col("i") / FANOUT).alias("i")).agg(
        *[F.max(F.when(slot == s, F.col("node"))).alias(SLOTS[s]) for s in range(FANOUT)])


def hash_in(column: str, field: str) -> Column:
    """The hash of a node that is a struct (``field`` names the hash in it) or a hash itself (no field)."""
    return F.col(f"{column}.{field}") if field else F.col(column)


def grow(nodes: DataFrame, most: int, field: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(pivoted levels from the lowest up, (g, node) of the group roots).

    ``nodes``: (g, n, i, node), groups of at most ``most``. Groups leave as soon as one node of theirs is left.
    """
    levels, roots = [], nodes.where("n = 1").select("g", hash_in("node", field).alias("node"))
    while most > 1:
        level = materialise(pivot(nodes.where("n > 1")), name)
        levels.append(level)
        up = digest(*[F.coalesce(hash_in(c, field), F.lit("")) for c in SLOTS])
        nodes, field = level.select("g", "n", "i", up.alias("node")), ""
        roots = roots.union(nodes.where("n = 1").select("g", "node"))
        most = -(-most // FANOUT)
    return levels, roots


def beside(field: str) -> str:
    """SQL that unfolds a parent into its slots: (s, node, beside), the hashes of all columns but the slot's own."""
    texts = [f"coalesce({c}.{field}, '')" if field else f"coalesce({c}, '')" for c in SLOTS]
    join = lambda some: f"concat({', '.join(some)})" if some else "''"
    children = [f"struct({s} AS s, {SLOTS[s]} AS node, struct({join(texts[:s])} AS l, {join(texts[s + 1:])} AS r) AS beside)"
                for s in range(FANOUT)]
    return f"explode(array({', '.join(children)}))"


def descend(levels: list[DataFrame], tops: DataFrame, field: str) -> DataFrame:
    """(subroot, i, node, path) of the children on the lowest level, from ``tops``: (g, n, subroot, path).

    A path lists, from the leaf's level up, what stands left and right of the node among its parent's children.
    """
    above = None
    for k in range(len(levels) - 1, -1, -1):
        # Groups whose single top node lies on this level begin here, the others come from the level above.
        begin = tops.where((F.col("n") > FANOUT ** k) & (F.col("n") <= FANOUT ** (k + 1))).select(
            "g", F.lit(0).cast("long").alias("i"), "subroot", "path")
        above = begin if above is None else begin.union(above.select("g", "i", "subroot", "path"))
        rows = levels[k].join(above, ["g", "i"]).select("g", "i", "subroot", "path", F.expr(beside(field if k == 0 else "")).alias("c"))
        above = rows.where("c.node is not null").select(
            "g", "subroot", (F.col("i") * FANOUT + F.col("c.s")).alias("i"), F.col("c.node").alias("node"),
            F.concat(F.array("c.beside"), "path").alias("path"))
    return above.select("subroot", "i", "node", "path")


def proof(path: Column) -> Column:
    """All siblings, level by level up to the root, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["l"], h, x["r"]))


def manifest(records: DataFrame, group: str, key: str, fields: list[str], presented: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) for every record.

    ``presented`` is the hash that is checked against the manifest (NULL: the record's own); ``folded_root`` is where
    it leads with the record's siblings, and ``verified`` whether that is the root.
    """
    if key in RESULTS:
        raise ValueError(f"the key must not be called {key}")
    offered = F.lit(None).cast("string") if presented is None else presented
    leaves = records.select(records[group].alias("grp"), records[key].alias("key"),
                            leaf_hash(*[records[f] for f in fields]).alias("leaf"), offered.alias("offered"))
    found, groups = numbered(leaves)
    found = materialise(found.select("g", "n", "i", F.struct("leaf", "key", "offered").alias("node")), "numbered")
    size = groups.agg(F.max("n").alias("most"), F.count("*").alias("count")).first()
    levels, roots = grow(found, size["most"] or 0, "leaf", "level")
    roots = materialise(roots, "subroots")
    long = lambda n: F.lit(n).cast("long")
    crowns = roots.select(long(0).alias("g"), long(size["count"]).alias("n"), F.col("g").alias("i"), "node")
    upper, crown = grow(crowns, size["count"], "", "crown")
    root, none = crown.first(), F.array().cast(PATH)
    if upper:
        top = records.sparkSession.range(1).select(long(0).alias("g"), long(size["count"]).alias("n"),
                                                   F.lit(None).cast("string").alias("subroot"), none.alias("path"))
        over = descend(upper, materialise(top, "top"), "").select(F.col("i").alias("g"), F.col("node").alias("subroot"), "path")
    else:
        over = roots.select("g", F.col("node").alias("subroot"), none.alias("path"))
    tops = materialise(over.join(groups, "g").select("g", "n", "subroot", "path"), "tops")
    rows = found.where("n = 1").select("g", "node").join(tops.drop("n"), "g").select("node", "subroot", "path")
    if levels:
        rows = rows.union(descend(levels, tops, "leaf").select("node", "subroot", "path"))
    rows = rows.select("node.*", "subroot", "path", F.lit(root["node"] if root else None).cast("string").alias("root"))
    folded = fold(F.coalesce("offered", "leaf"), F.col("path"))
    return rows.select(F.col("key").alias(key), "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
