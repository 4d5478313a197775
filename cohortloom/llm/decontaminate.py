"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded slice of whole documents of one partition. Its words become symbols: a number per
benchmark word, 0 for every other word and between documents, since no benchmark phrase holds one. The
text of the index is made of the stretches between zeros that are long enough to hold a phrase; shorter
ones can hold none, so nothing is lost. Its suffix order gives the Burrows-Wheeler transform, kept as a
wavelet matrix with ranks, and a sample of suffix positions. All windows of the benchmark items go
through backward search together; occurrences are located by walking to the nearest sampled position,
and overlapping ones are merged into removal spans.

A window is a run of ``width`` item words; an item of fewer words, but not none, is one window. A-Z
counts as a-z. Words are runs of ASCII letters and digits and of all other non-ASCII characters.
The benchmark is read in blocks of bounded size that are searched one after the other.

NULL or empty texts have no words and no hits. Items without words are never found. Repeated rows are
judged each on its own, repeated items once per id, items with a NULL id are left out of the item list
but their windows count as hits. An empty table gives an empty result, an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import words

WIDTH = 10
BLOCK_BYTES = 8 << 20   # benchmark text searched, and sent to the tasks, at a time
SHARD_BYTES = 2 << 20   # document text per index
SAMPLE = 8              # every so many text positions keep their place


class Phrases:
    """Windows of one benchmark block as rows of symbols, grouped by length."""

    def __init__(self, items: list[tuple[object, str]], width: int):
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = words.utf8(column)
        start, end, row = words.spans(data, offsets, words.LETTERS_DIGITS)
        hashed = words.hashes(data, start, end)
        self.vocabulary, code = np.unique(hashed, return_inverse=True)
        symbol = code.astype(np.int64) + 1
        found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        first = np.searchsorted(row, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = symbol[first[i]:first[i + 1]]
            for at in range(max(len(own) - width, 0) + 1 if len(own) else 0):
                window = own[at:at + width]
                found.setdefault(window.tobytes(), (window, set()))[1].add(i)
        groups: dict[int, list] = {}
        for window, owners in found.values():
            groups.setdefault(len(window), []).append((window, owners))
        self.groups = {n: (np.stack([w for w, _ in g]), [sorted(o) for _, o in g]) for n, g in groups.items()}
        self.shortest = min(self.groups, default=0)
        self.names = [None if n is None else str(n) for n, _ in items]

    def symbols(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane with counts per symbol bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        current = sequence
        for b in range(bits - 1, -1, -1):
            bit = (current >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        begin, end = np.zeros_like(at), at
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            begin = np.where(up, zeros + ones[begin], begin - ones[begin])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit == 1, self.zeros[level] + ones[at], at - ones[at])
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the text ends in a symbol smaller than all others."""
    order = np.argsort(text)
    key = text[order]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    rank = np.empty(len(text), np.int64)
    rank[order] = group
    step = 1
    while group[-1] < len(text) - 1:
        following = np.full(len(text), -1, np.int64)
        following[:-step] = rank[step:]
        pair = rank * (len(text) + 1) + following + 1
        order = np.argsort(pair)
        key = pair[order]
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(len(text), np.int64)
        rank[order] = group
        step *= 2
    return order


class FMIndex:
    """Backward search and location over one sequence of symbols of at least 1."""

    def __init__(self, sequence: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate((sequence, [0]))
        order = suffix_order(text)
        transform = text[order - 1]
        bits = max(int(text.max()).bit_length(), 1)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.matrix = WaveletMatrix(transform, bits)
        kept = order % sample == 0
        self.marked = np.concatenate(([0], np.cumsum(kept)))
        self.places = order[kept]
        self.size = len(text)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) row of the suffixes that start with each pattern; none where they are equal."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            known = symbol < len(self.less) - 1
            symbol = np.where(known, symbol, 0)
            begin = self.less[symbol] + self.matrix.rank(symbol, low[alive])
            end = self.less[symbol] + self.matrix.rank(symbol, high[alive])
            low[alive], high[alive] = np.where(known, begin, 0), np.where(known, end, 0)
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            hit = self.marked[at + 1] > self.marked[at]
            out[open_rows[hit]] = self.places[self.marked[at[hit]]] + steps
            open_rows, at = open_rows[~hit], at[~hit]
            symbol = self.matrix.access(at)
            rows[open_rows] = self.less[symbol] + self.matrix.rank(symbol, at)
            steps += 1
        return out


def occurrences(symbol: np.ndarray, row: np.ndarray, phrases: Phrases) -> list[tuple[np.ndarray, int, np.ndarray, list]]:
    """For every phrase length: (word places, length, phrase numbers, owners) of all occurrences."""
    if not phrases.shortest or not len(symbol):
        return []
    inside = symbol > 0
    fresh = np.concatenate(([True], row[1:] != row[:-1]))
    run = np.cumsum(fresh | ~inside | np.concatenate(([True], ~inside[:-1])))
    length = np.bincount(run[inside], minlength=int(run[-1]) + 1)
    used = inside & (length[run] >= phrases.shortest)
    place = np.flatnonzero(used)
    if not len(place):
        return []
    # One separator, larger than any symbol, between stretches keeps matches inside them.
    gap = np.concatenate(([0], np.cumsum(run[place][1:] != run[place][:-1])))
    sequence = np.full(len(place) + int(gap[-1]), len(phrases.vocabulary) + 1, np.int64)
    spot = np.arange(len(place)) + gap
    sequence[spot] = symbol[place]
    origin = np.full(len(sequence), -1, np.int64)
    origin[spot] = place
    index = FMIndex(sequence)
    out = []
    for n, (patterns, owners) in phrases.groups.items():
        low, high = index.find(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        if len(which):
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            out.append((origin[index.locate(rows)], n, which, owners))
    return out


def search(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set], tuple]:
    """(words per row, hit flag per word, item numbers per row, word spans) of one shard."""
    start, end, row = words.spans(data, offsets, words.LETTERS_DIGITS)
    rows = len(offsets) - 1
    symbol = phrases.symbols(words.hashes(data, start, end))
    change = np.zeros(len(symbol) + 1, np.int64)
    items: list[set] = [set() for _ in range(rows)]
    for places, n, which, owners in occurrences(symbol, row, phrases):
        np.add.at(change, places, 1)
        np.add.at(change, places + n, -1)
        for r, w in set(zip(row[places].tolist(), which.tolist(), strict=True)):
            items[r].update(owners[w])
    return np.bincount(row, minlength=rows), np.cumsum(change[:-1]) > 0, items, (start, end, row)


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, width: int,
                     block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The benchmark as broadcast phrase tables, each made from at most about ``block_bytes`` of text."""
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"), benchmark[text].alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 32).alias("n")).first()["n"] or 0
    blocks = max(-(-int(total) // block_bytes), 1)
    spark = benchmark.sparkSession
    shared = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        shared.append(spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in part.collect()], width)))
    return shared


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("spans", T.ArrayType(T.LongType(), False)),
                      T.StructField("items", T.ArrayType(T.StringType(), False)),
                      T.StructField("clean_text", T.StringType())])


def merged(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of flagged words of one document."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(start[np.flatnonzero(edge == 1)].tolist(), end[np.flatnonzero(edge == -1) - 1].tolist(), strict=True))


def cut(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    """The text without its spans, each replaced by a line break."""
    parts, at = [], 0
    for a, b in removed:
        parts.append(text[at:a])
        at = b
    return b"\n".join([*parts, text[at:]]).strip()


def search_all(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
               width: int = WIDTH, item_id: str = "item_id", item_text: str = "text", clean: bool = False,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc`` (a struct of the kept columns, all by default) and ``found`` (n_words, n_hit, byte ``spans``
    as start, end, start, ..., sorted ``items``, ``clean_text``). ``clean_text`` is set, with ``clean``, for
    hit documents only: the text without the spans, searched again until nothing is found."""
    blocks = benchmark_blocks(benchmark, item_id, item_text, width, block_bytes)
    names = docs.columns if keep is None else keep
    # Two columns of fixed names: what is kept may be called anything.
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("doc"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType([packed.schema["doc"], T.StructField("found", FOUND)])

    def scan(column: pa.Array) -> tuple:
        data, offsets = words.utf8(column)
        rows = len(offsets) - 1
        flags, items, n = None, [set() for _ in range(rows)], np.zeros(rows, np.int64)
        for shared in blocks:
            n, hit, owners, span = search(data, offsets, shared.value)
            flags = hit if flags is None else flags | hit
            for r in range(rows):
                items[r].update(shared.value.names[i] for i in owners[r] if shared.value.names[i] is not None)
        return data, offsets, n, flags, items, span

    def cleaned(raw: bytes, removed: list[tuple[int, int]]) -> str:
        while removed:
            raw = cut(raw, removed)
            data, offsets, _, flags, _, (start, end, _) = scan(pa.array([raw.decode()]))
            removed = merged(flags, start, end)
        return raw.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SHARD_BYTES):
            data, offsets, n, flags, items, (start, end, row) = scan(batch.column("text"))
            first = np.searchsorted(row, np.arange(len(offsets)))
            n_hit = np.bincount(row, weights=flags, minlength=len(n)).astype(np.int64)
            spans, texts = [[] for _ in range(len(n))], [None] * len(n)
            for r in np.flatnonzero(n_hit).tolist():
                a, b = first[r], first[r + 1]
                own = merged(flags[a:b], start[a:b] - offsets[r], end[a:b] - offsets[r])
                spans[r] = [x for pair in own for x in pair]
                if clean:
                    texts[r] = cleaned(data[offsets[r]:offsets[r + 1]].tobytes(), own)
            found = pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(n_hit), pa.array(spans, pa.list_(pa.int64())),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(texts, pa.string())],
                FOUND.names)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), found], ["doc", "found"])

    return packed.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, keep: list[str], **options) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated next to the kept columns."""
    d, f = F.col("doc"), F.col("found")
    return search_all(docs, benchmark, keep=keep, **options).select(
        *[d[c].alias(c) for c in keep], f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", length: str | None = "n_chars",
           **options) -> DataFrame:
    """The documents with their own columns, without the removal spans. ``length`` is set anew where a text
    changed; a document of which nothing is left goes, all others stay as they are."""
    d, f = F.col("doc"), F.col("found")
    changed = f["n_hit"] > 0

    def value(c):
        if c == text:
            return F.when(changed, f["clean_text"]).otherwise(d[c])
        if c == length:
            return F.when(changed, F.length(f["clean_text"]).cast(docs.schema[c].dataType)).otherwise(d[c])
        return d[c]

    return (search_all(docs, benchmark, text=text, clean=True, **options)
            .where(~changed | (f["clean_text"] != "")).select(*[value(c).alias(c) for c in docs.columns]))
