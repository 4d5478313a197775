"""Near-duplicates by an LSH forest of MinHash signatures.

Documents are sets of k-word shingles (a shorter text is one shingle). Equal sets are folded into one class
by a 128-bit digest, so copies never meet each other. Every class gets ``trees`` signatures of ``depth`` minima
each. In every tree the classes are sorted by signature, which puts those with long common prefixes side by
side; candidates are neighbours with a common prefix. The depth adapts to the region: where few classes share a
prefix a short one is enough to be within reach, and where more share it than the reach, only those with longer
common prefixes are. In such crowded regions each class also meets the few classes nearest to the region's bitwise
majority, which links most of a large group of copies.

The reach decides no link: classes of a crowded region that these links leave in different components are compared
with all others of their region, in blocks, first by sketch and then by full shingle sets. So two classes meet if
they share the first five minima of any tree, however many others do.

Candidates are searched twice. The first search, in two trees, takes next neighbours and one leader per crowded region;
its confirmed links tie most of a large group of near copies. The second one, in all trees, makes pairs only of classes
that are still in different components, so a group of n copies costs about n comparisons and not as many as it has pairs.

Candidates whose sign sketches are too far apart to come from similar sets are left out (five standard
deviations below the threshold); the rest are confirmed on full shingle sets, and components follow by
alternating large-star and small-star steps over the links.

Texts without words link with nothing. NULL ids take part and have NULL as component only if nothing
else is reachable. Rows with the same id and different texts are told apart by their sets; their ids count
in the classes of both. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import words
from cohortloom.session import materialise

TREES, DEPTH = 32, 8
REACH = 12                # neighbours on each side in sorted order
CROWD, CROWD_DEPTH = 48, 5  # where more classes than this share so long a prefix, the reach is
CROWD_REACH = 2             # this, and the rest is left to the other trees, to
LEADERS = 2                 # the classes nearest to the majority of a crowded region, and to crowd_links
CROWDED_DEPTHS = (3, 5, 8)
RANGE_ROWS = 200_000      # sorted rows per task
BROADCAST_ROWS = 500_000  # of 20 bytes each
FIRST_TREES = 2           # trees of the first round, which only ties neighbours and one leader per crowded region
BLOCK, BLOCK_BYTES = 512, 4 << 20  # classes and bytes of text on each side of a comparison of crowded classes

_rng = np.random.default_rng(77_003)
_MULT = _rng.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)

PROFILE = "doc_id {id}, n_shingles long, cls binary, keys binary, sketch binary, text_hash long, text_bytes int"


def row_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct shingle hashes, their rows in order, number of rows) of a text column."""
    data, offsets = words.utf8(column)
    rows = len(offsets) - 1
    start, end, row = words.spans(data, offsets, words.NON_BLANK)
    value, owner = words.shingles(words.hashes(data, start, end), row, rows, k)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
        value, owner = value[fresh], owner[fresh]
    return value, owner, rows


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of all hash functions per set: one row of 32-bit values per start in ``first``."""
    x = words.mix(value).astype(np.uint32)
    out = np.empty((len(_MULT), len(first)), np.uint32)
    for i, (a, b) in enumerate(zip(_MULT, _ADD, strict=True)):
        h = x * a + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[i] = np.minimum.reduceat(h, first)
    return out.T


def tree_keys(sign: np.ndarray) -> np.ndarray:
    """Signatures as big-endian bytes that sort by tree level. All 32 bits count: the minima of long texts are small
    numbers that differ in their low bits only."""
    return sign.astype(">u4")


def profiles(docs: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """Set size, class digest, tree keys and sketch of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            value, owner, rows = row_sets(batch.column("text"), k)
            n = np.bincount(owner, minlength=rows)
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            cls, keys, sketch = [None] * rows, [None] * rows, [None] * rows
            if len(some):
                digest = np.stack([np.add.reduceat(words.mix(value ^ np.uint64(c)), first)
                                   for c in (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)], 1)
                sign = signatures(value, first)
                tree = tree_keys(sign)
                bit = np.packbits((sign & np.uint32(1)).astype(np.uint8), axis=1)
                for i, r in enumerate(some.tolist()):
                    cls[r], keys[r], sketch[r] = digest[i].tobytes(), tree[i].tobytes(), bit[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (cls, keys, sketch)),
                 batch.column("text_hash"), batch.column("text_bytes")],
                ["doc_id", "n_shingles", "cls", "keys", "sketch", "text_hash", "text_bytes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"),
                       F.octet_length(docs[text]).alias("text_bytes")).mapInArrow(
        run, PROFILE.format(id=kind))


def least_agreement(similarity: float, bits: int) -> int:
    """Equal sketch bits that sets of at least this similarity reach but for five standard deviations."""
    p = (1 + similarity) / 2
    return int(np.floor(bits * p - 5 * np.sqrt(bits * p * (1 - p))))


def tree_pairs(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, need: int, root: np.ndarray | None = None,
               first: bool = False) -> np.ndarray:
    """Candidate pairs of one sorted run of (tree, signature) rows; ``key`` has the tree in column 0. Classes of one
    ``root`` are linked already and make no pair, nor do two of one run of ``crowd_runs``, where all meet anyway;
    ``first``: next neighbours and one leader only, in crowded runs too."""
    root = node if root is None else root
    n, bits = len(node), sketch.shape[1] * 64
    if n < 2:
        return np.zeros((0, 2), np.int64)
    same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1)  # common prefix with the row before, tree included
    found = []
    crowd, crowded = crowd_runs(key)
    if first:
        crowded = np.zeros(n, bool)

    def close(a, b):
        apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1)
        ok = (bits - apart >= need) & (root[a] != root[b]) & ~(crowded[a] & (crowd[a] == crowd[b]))
        found.append(np.stack([np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])], 1))

    common = same.copy()
    run = np.concatenate(([0], np.cumsum(same < CROWD_DEPTH + 1)))
    sparse = np.bincount(run)[run] <= CROWD
    for step in range(1, min(1 if first else REACH, n - 1) + 1):
        if step > 1:
            common = np.minimum(common[:-1], same[step - 1:])
        at = np.flatnonzero((common >= 2) & (sparse[:n - step] | (step <= CROWD_REACH)))
        close(at, at + step)
    for depth in CROWDED_DEPTHS[:1] if first else CROWDED_DEPTHS:
        run = np.concatenate(([0], np.cumsum(same < depth + 1)))
        size = np.bincount(run)
        for r in np.flatnonzero(size > REACH):
            a = int(np.searchsorted(run, r))
            members = np.arange(a, a + size[r])
            raw = np.unpackbits(sketch[members].view(np.uint8), axis=1)
            majority = raw.mean(0) > 0.5
            lead = members[np.argsort((raw != majority).sum(1), kind="stable")[:1 if first else LEADERS]]
            for one in lead:
                close(members, np.full(len(members), one))
    return np.unique(np.concatenate(found), axis=0)


def crowd_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run of every row of a sorted part, and whether the reach does not cover it in full, or it is the first or last
    one, which may go on in other parts."""
    same = np.cumprod(key[1:] == key[:-1], axis=1).sum(1)
    run = np.concatenate(([0], np.cumsum(same < CROWD_DEPTH + 1)))
    take = np.bincount(run) > REACH + 1
    take[[0, -1]] = True
    return run, take[run]


def crowd_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their run) of the runs that ``crowd_runs`` finds crowded. Runs are negative numbers, the same in all parts."""
    rows = np.flatnonzero(crowd_runs(key)[1])
    name = np.zeros(len(rows), np.uint64)
    for level in range(CROWD_DEPTH + 1):
        name = words.mix(name + key[rows, level].astype(np.uint64) + np.uint64(1))
    return rows, (name | np.uint64(1 << 63)).view(np.int64)


def candidates(classes: DataFrame, similarity: float, count: int, first: bool = False) -> DataFrame:
    """(a, b, run): different pairs a < b of class numbers whose signatures meet in some tree, without run, and the
    classes a of every crowded run, without b. ``classes``: (node, root, keys, sketch); pairs lie between roots.
    ``first``: a few pairs of the first trees only."""
    need, trees = least_agreement(similarity, TREES * DEPTH), FIRST_TREES if first else TREES
    rows = classes.select("node", "root", "sketch", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.col("keys").substr(t * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("key")))).alias("x"))
    rows = rows.select(F.col("x.tree").alias("tree"), F.col("x.key").alias("key"), "node", "root", "sketch")
    parts = max(-(-count * trees // RANGE_ROWS), 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        key = np.frombuffer(b"".join(table["key"].to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint32)
        key = np.concatenate([table["tree"].to_numpy()[:, None].astype(np.uint32), key], 1)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(key), -1)
        node = table["node"].to_numpy()
        pairs = tree_pairs(key, node, sketch, need, table["root"].to_numpy(), first)
        crowded, name = crowd_rows(key) if not first else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a, b, run in ((pairs[:, 0], pairs[:, 1], None), (node[crowded], None, name)):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b),
                                              none if run is None else pa.array(run)], ["a", "b", "run"])

    ordered = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return ordered.mapInArrow(run, "a long, b long, run long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * shared shingles >= percent * all shingles, from the full texts.

    ``texts``: (node, text), one row per class.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text_a"):
            for part in words.slices(iter([batch]), "text_b"):
                left, left_row, rows = row_sets(part.column("text_a"), k)
                right, right_row, _ = row_sets(part.column("text_b"), k)
                both = np.concatenate([left, right])
                owner = np.concatenate([left_row, right_row])
                order = np.lexsort((both, owner))
                both, owner = both[order], owner[order]
                twice = np.flatnonzero((both[1:] == both[:-1]) & (owner[1:] == owner[:-1]))
                shared = np.bincount(owner[twice], minlength=rows)
                total = np.bincount(owner, minlength=rows) - shared
                ok = pa.array(100 * shared >= percent * total)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def local_forests(links: DataFrame) -> DataFrame:
    """Stars (u, v), u > v, with the components that the links of each partition make on their own.

    A partition never gives more rows than it has nodes, however many links a group of near copies has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x):
            path = []
            while (up := parent.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                parent[y] = x
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        stars = [(x, root(x)) for x in list(parent)]
        stars = np.array([p for p in stars if p[0] != p[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["u", "v"])

    return links.select("a", "b").mapInArrow(run, "u long, v long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest reachable node, for every node that has a link.

    The links are written and folded per stored partition first. Large-star links every larger neighbour of a node to its smallest one, small-star does so for the smaller
    ones; both keep components, and the links end as stars. Each round writes its links.
    """
    def shape(row):
        return (row["n"], row["h"])

    def digest(edges):
        return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    edges = materialise(local_forests(materialise(links, "links")).distinct(), name)
    before = shape(digest(edges))
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialise(
            small.select("u", F.col("m").alias("v"))
            .union(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct(), name)
        after = shape(digest(edges))
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def class_texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(node, text) for the wanted classes, from any row that holds the class's chosen text.

    ``wanted``: (node, text_hash, text_bytes). It is broadcast while it is small, by count, and joined by
    shuffle beyond that.
    """
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    body = docs[text]
    found = docs.select(body.alias("text"), F.xxhash64(body).alias("text_hash"), F.octet_length(body).alias("text_bytes"))
    return found.join(wanted, ["text_hash", "text_bytes"]).groupBy("node").agg(F.first("text").alias("text"))


def block_pairs(x: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which members of a cell are to be compared: those of its two blocks, or of its only one, in different components."""
    apart = root[:, None] != root[None, :]
    return apart & (x[:, None] != x[None, :]) if len(np.unique(x)) > 1 else apart


def shared_counts(value: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Number of common values of every two of ``rows`` sets."""
    _, column, times = np.unique(value, return_inverse=True, return_counts=True)
    out = np.zeros((rows, rows), np.float32)
    common = np.flatnonzero(times > max(rows // 8, 1))  # in many sets: as dense columns
    place = np.full(len(times), -1)
    place[common] = np.arange(len(common))
    for start in range(0, len(common), 4096):
        at = np.flatnonzero((place[column] >= start) & (place[column] < start + 4096))
        dense = np.zeros((rows, min(4096, len(common) - start)), np.float32)
        dense[owner[at], place[column[at]] - start] = 1
        out += dense @ dense.T
    rest = np.flatnonzero((place[column] < 0) & (times[column] > 1))  # in few: by the list of their sets
    column, owner = column[rest], owner[rest]
    order = np.argsort(column, kind="stable")
    lists = owner[order]
    first, size = np.searchsorted(column[order], column), times[column]
    edge = np.searchsorted(owner, np.arange(rows + 1))
    for r in range(rows):
        f, n = first[edge[r]:edge[r + 1]], size[edge[r]:edge[r + 1]]
        if len(n):
            at = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out[r] += np.bincount(lists[at], minlength=rows)
    return out.astype(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """As many of the links as tie the same together."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (u := root(x)) != (v := root(y)):
            parent[u] = v
            kept.append((x, y))
    return [x for x, _ in kept], [y for _, y in kept]


def crowd_links(crowd: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, text: str, k: int,
                percent: int) -> DataFrame | None:
    """Links (a, b) between classes of crowded runs that are in different components so far, or None.

    ``crowd``: (node, run). Runs with members in common are taken together, so that two classes are compared once. A
    group is cut into blocks, and every two blocks make a cell. Cells drop classes whose sketch is close to none
    first, then the texts of the others are compared in full. A cell gives fewer links than it has classes.
    """
    need = least_agreement(percent / 100, TREES * DEPTH)
    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = materialise(rooted(crowd), "crowd")
    mixed = inside.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("run")
    mixed = materialise(inside.join(mixed, "run"), "mixed")
    if mixed.isEmpty():
        return None
    groups = components(mixed.select(F.col("run").alias("a"), F.col("node").alias("b")), "crowds").where("node >= 0")
    members = materialise(rooted(groups.withColumnRenamed("root", "crowd").join(
        classes.select("node", "sketch", "text_bytes"), "node")), "members")
    blocks = members.groupBy("crowd").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("text_bytes").cast("long")) / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    cells = members.join(blocks, "crowd").withColumn("x", F.pmod(F.xxhash64("node"), "blocks")).select(
        "crowd", "node", "root", "sketch", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y")).select(
        "crowd", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "node", "root", "sketch")

    def close(table: pa.Table) -> pa.Table:
        x, root = table["x"].to_numpy(), table["root"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(x), -1)
        if table["i"][0] != table["j"][0] and len(np.unique(x)) < 2:
            return table.slice(0, 0).drop_columns(["sketch"])
        apart = np.zeros((len(x), len(x)), np.int16)
        for w in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[:, None, w] ^ sketch[None, :, w])
        ok = block_pairs(x, root) & (sketch.shape[1] * 64 - apart >= need)
        return table.drop_columns(["sketch"]).filter(pa.array(ok.any(1)))

    def exact(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, x = (table[c].to_numpy() for c in ("node", "root", "x"))
        texts = table["text"]
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        value, owner, rows = row_sets(texts, k)
        size = np.bincount(owner, minlength=rows)
        shared = shared_counts(value, owner, rows)
        ok = block_pairs(x, root) & (100 * shared >= percent * (size[:, None] + size[None, :] - shared))
        a, b = np.nonzero(np.triu(ok))
        a, b = spanning(node[a], node[b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    key = "crowd long, i long, j long, x long, node long, root long"
    near = materialise(cells.groupBy("crowd", "i", "j").applyInArrow(close, key), "near")
    wanted = materialise(classes.select("node", "text_hash", "text_bytes").join(near.select("node").distinct(), "node"), "wanted")
    texts = materialise(class_texts(docs, wanted, text), "texts")
    return materialise(near.join(texts, "node").groupBy("crowd", "i", "j").applyInArrow(exact, "a long, b long"), "crowd_links")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = materialise(profiles(docs, k, doc_id, text), "profiles")
    folded = rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least_id"),
        F.first(F.struct("keys", "sketch", "text_hash", "text_bytes")).alias("of"))  # any member will do
    classes = materialise(folded.select("cls", "least_id", "of.*", F.monotonically_increasing_id().alias("node")), "classes")
    count, similarity = classes.count(), percent / 100

    def links(pairs: DataFrame) -> DataFrame:
        near = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = materialise(classes.select("node", "text_hash", "text_bytes").join(near, "node"), "wanted")
        return confirmed(pairs, materialise(class_texts(docs, wanted, text), "texts"), k, percent)

    # A first round ties most of a large group of near copies with a few pairs per class. After it, only pairs whose
    # classes are still in different components are made at all, so a group of n copies costs about n comparisons.
    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tied = materialise(candidates(classes.withColumn("root", F.col("node")), similarity, count, first=True).select("a", "b"), "tied")
    roots = components(links(tied))
    met = materialise(candidates(rooted(classes), similarity, count), "pairs")
    roots = components(roots.toDF("a", "b").union(links(met.where("run is null").select("a", "b"))))
    crowd = met.where("run is not null").select(F.col("a").alias("node"), "run")
    more = crowd_links(crowd, classes, roots, docs, text, k, percent)
    if more is not None and not more.isEmpty():
        roots = components(roots.toDF("a", "b").unionByName(more))
    linked = classes.select("node", "cls", "least_id").join(roots, "node", "left").select(
        "cls", "least_id", F.coalesce("root", "node").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("least_id").alias("smallest"))
    of_class = linked.join(smallest, "root").select("cls", "smallest")
    component = F.coalesce("smallest", "doc_id")
    return rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns whatever they are called, of which one per component stays.

    That is the one with the smallest id; one without an id stays only where none in its component has one. Rows are
    judged one by one, by numbers that are written with them: rows that share an id and have unrelated texts both stay,
    and of equal ids in a component the row with the smallest number stays.
    """
    rows = materialise(docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
                                   F.monotonically_increasing_id().alias("row")), "rows")
    bodies = rows.select("row", F.col("doc")[text].alias("text"))
    judged = near_components(bodies, k, percent, "row", "text").select(F.col("doc_id").alias("row"), "component_id")
    groups = judged.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    shared = materialise(judged.join(groups, "component_id").join(
        rows.select("row", F.col("doc")[doc_id].alias("id")), "row"), "shared")
    kept = shared.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("of"))
    gone = materialise(shared.select("row").join(kept.select("of.row"), "row", "left_anti"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
