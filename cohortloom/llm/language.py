"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts every letter of a word, and the word's end, from up to ``order`` - 1 letters
before it in the word. Models are learned from labelled documents: counts come from Spark aggregations over at
most about ``SAMPLE_DOCS`` documents per language, chosen by a hash of their id (the bound on what the models hold).
They are kept as one sorted array of n-gram hashes per order with a row of weights per language, sent to the tasks
after a check of its size. A text gets the language of the lowest cross-entropy per symbol; all of it is read.

Rejection is calibrated on the learning sample: a text is rejected if it has no letter or if its cross-entropy lies
further above its language's mean than the sample's own texts do, and
nearer to pure chance than to that mean. The score is the share of the chosen language
under a softmax whose temperature gives the sample the least log loss.

Letters are Unicode letters in lower case; all else separates words. NULL texts and texts without letters are
``und`` with score 0 and are rejected. Equal cross-entropies go to the first language by name. Repeated rows are
judged each; rows with NULL id or language teach nothing. An empty table gives an empty result; without any
labelled row all texts are ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import words

ORDER = 5
SAMPLE_DOCS = 400           # labelled documents per language that the models are fitted on, in expectation
MAX_LANGUAGES = 500
MAX_MODEL_BYTES = 256 << 20
SLICE_BYTES = 2 << 20
CACHED_WORDS = 150_000       # per task
TEMPERATURES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
UNKNOWN = "und"
BEGIN, END = "\x02", "\x03"

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters or marks that belong to them."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def _powers(order: int) -> np.ndarray:
    return np.cumprod(np.array([1, *[_RADIX] * (order - 1)], np.uint64))


def _finish(total: np.ndarray, n: int) -> np.ndarray:
    return words.mix(total + np.full(1, n, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_keys(codes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1 to order: the hash of the n codes that end at each position."""
    codes = codes.astype(np.uint64)
    total = np.zeros(len(codes), np.uint64)
    for n, power in enumerate(_powers(order), 1):
        if n > len(codes):
            yield _finish(total, n)
            continue
        total[n - 1:] += codes[:len(codes) - n + 1] * power
        yield _finish(total, n)


def keys_of(grams: list[str], n: int) -> np.ndarray:
    """The hashes of whole grams of n symbols, as ``gram_keys`` gives them at the last symbol."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), n).astype(np.uint64)
    return _finish((codes[:, ::-1] * _powers(n)).sum(1, dtype=np.uint64), n)


@dataclass
class Models:
    """Sorted n-gram hashes per order, with one column of weights per language.

    ``grams[n]`` -> discounted share of the last symbol after its context; ``contexts[n]`` -> (known, share
    that is handed to the shorter context) of the n symbols before a symbol.
    """
    languages: list[str]
    order: int
    symbols: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    temperature: float = 1.0

    @property
    def nbytes(self) -> int:
        return sum(k.nbytes + v.nbytes for k, v in [*self.grams, *self.contexts])

    @staticmethod
    def _look(table, key, missing):
        keys, values = table
        if not len(keys):
            return np.full((len(key), values.shape[1]), missing, np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        out = values[at]
        out[keys[at] != key] = missing
        return out

    def surprise(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """-log2 probability of every symbol per language. ``place``: its place in its word, 0 for BEGIN,
        which is not predicted (0 there)."""
        p = np.full((len(codes), len(self.languages)), 1.0 / self.symbols)
        before = None
        for n, key in enumerate(gram_keys(codes, self.order)):
            share = self._look(self.grams[n], key, 0.0)
            if n == 0:
                handed = np.broadcast_to(self.contexts[0][1], p.shape)
            else:
                handed = np.ones(p.shape, np.float32)
                handed[1:] = self._look(self.contexts[n], before[:-1], 1.0)
                handed[place < n] = 1.0
                share[place < n] = 0.0
            p = share + handed * p
            before = key
        out = -np.log2(p)
        out[place == 0] = 0.0
        return out


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, chosen: Column) -> DataFrame:
    """(lang, text) of the bounded sample: each language's share follows from its number of labelled rows."""
    rows = docs.where(chosen).select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[text].alias("text")).where(
        "lang is not null and doc_id is not null")
    counts = rows.groupBy("lang").count()
    if (n := counts.count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES} fit one model")
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts), "lang").where(place < F.lit(float(SAMPLE_DOCS)) / F.col("count")).select("lang", "text")


def gram_weights(sample: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, share), (lang, ctx, handed)) of interpolated Kneser-Ney models."""
    word = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    counted = sample.select("lang", word.alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    marked = counted.select("lang", "c", F.concat(F.lit(BEGIN), "w", F.lit(END)).alias("s"))
    ends = F.sequence(F.lit(2), F.length("s"))
    starts = marked.select("lang", "c", "s", F.explode(ends).alias("at")).select(
        "lang", "c", "s", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("at")))).alias("n"))
    raw = starts.select("lang", "c", F.col("s").substr(F.col("at") - F.col("n") + 1, F.col("n")).alias("gram")).groupBy(
        "lang", "gram").agg(F.sum("c").alias("c"))
    # Below the highest order a gram counts by the different symbols before it, unless a word begins with it.
    longer = raw.where(F.length("gram") > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(
        F.count("*").alias("kinds"))
    use_raw = (F.length("gram") == order) | F.col("gram").startswith(BEGIN)
    grams = raw.join(longer, ["lang", "gram"], "left").select(
        "lang", "gram", F.when(use_raw, F.col("c")).otherwise(F.coalesce("kinds", "c")).alias("c"),
        F.expr("substring(gram, 1, length(gram) - 1)").alias("ctx"), F.length("gram").alias("n"))
    once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discounts = grams.groupBy("lang", "n").agg(
        F.greatest(F.least(F.coalesce(F.try_divide(once, once + 2 * twice), F.lit(0.5)), F.lit(0.95)), F.lit(0.05)).alias("d"))
    totals = grams.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), F.first("n").alias("n"))
    weighed = totals.join(discounts, ["lang", "n"])
    handed = weighed.select("lang", "ctx", (F.col("d") * F.col("kinds") / F.col("total")).alias("handed"))
    share = grams.join(weighed.select("lang", "ctx", "total", "d"), ["lang", "ctx"]).select(
        "lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("share"))
    return share, handed


def _sorted_table(grams: list[str], lang: np.ndarray, value: np.ndarray, width: int, n: int,
                  missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of grams of n symbols, and a row of weights per language for each."""
    if not grams:
        return np.zeros(0, np.uint64), np.zeros((0, width), np.float32)
    keys, which = np.unique(keys_of(grams, n), return_inverse=True)
    if len(keys) != len(set(grams)):
        raise ValueError("two n-grams share a hash")
    table = np.full((len(keys), width), missing, np.float32)
    table[which, lang] = value
    return keys, table


def fit(docs: DataFrame, chosen: Column, order: int = ORDER, doc_id: str = "doc_id", text: str = "text",
        lang: str = "lang") -> Models:
    """Models of all languages among the chosen rows, calibrated on the same sample."""
    sample = training_rows(docs, doc_id, text, lang, chosen).persist()
    try:
        share, handed = gram_weights(sample, order)
        share_of, handed_of = share.toArrow(), handed.toArrow()
        names = sorted(pc.unique(share_of["lang"]).to_pylist())

        def tables(rows, column, value, sizes, missing):
            grams = np.array(rows[column].to_pylist(), object)
            lang = np.searchsorted(names, rows["lang"].to_pylist())
            size = np.fromiter(map(len, grams), np.int64, len(grams))
            worth = rows[value].to_numpy()
            return [_sorted_table(grams[size == n].tolist(), lang[size == n], worth[size == n], len(names), n, missing)
                    for n in sizes]

        alphabet = set("".join(g for g in share_of["gram"].to_pylist() if len(g) == 1))
        none = handed_of.filter(pc.equal(handed_of["ctx"], ""))
        first = np.ones((1, len(names)), np.float32)
        first[0, np.searchsorted(names, none["lang"].to_pylist())] = none["handed"].to_numpy()
        model = Models(names, order, len(alphabet) + 1, tables(share_of, "gram", "share", range(1, order + 1), 0.0),
                       [(np.zeros(0, np.uint64), first),
                        *tables(handed_of, "ctx", "handed", range(1, order), 1.0)])
        if model.nbytes > MAX_MODEL_BYTES:
            raise ValueError(f"models of {model.nbytes} bytes; lower SAMPLE_DOCS or the order")
        if names:
            _calibrate(sample, model)
    finally:
        sample.unpersist()
    return model


def _calibrate(sample: DataFrame, model: Models) -> None:
    """Mean and spread of the cross-entropy per language, and the temperature, from one aggregation."""
    seen = entropies(sample, model, ["lang"]).where("__symbols >= 50")
    own = F.element_at(F.col("__h"), F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int"))
    loss = [F.avg(-F.log(F.greatest(_softmax(own, t), F.lit(1e-9)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    per = {r["lang"]: r for r in seen.groupBy("lang").agg(F.avg(own).alias("m"), F.stddev_pop(own).alias("s")).collect()}
    model.mean = np.array([per[n]["m"] if n in per else np.inf for n in model.languages])
    model.spread = np.array([max(per[n]["s"], 0.02) if n in per else 0.0 for n in model.languages])
    best = seen.agg(*loss).first()
    values = [best[f"t{i}"] for i in range(len(TEMPERATURES))]
    model.temperature = TEMPERATURES[int(np.argmin(values))] if values[0] is not None else 1.0


def _softmax(of: Column, temperature: float) -> Column:
    """Share of a language with cross-entropy ``of`` among ``__h``, sharper for longer texts."""
    sharp = F.lit(float(temperature)) * F.sqrt(F.col("__symbols"))
    return 1 / F.aggregate("__h", F.lit(0.0), lambda a, x: a + F.exp(F.least((of - x) * sharp, F.lit(500.0))))


def entropies(docs: DataFrame, model: Models, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``__symbols`` (letters and word ends) and ``__h`` (bits per symbol and language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType([packed.schema["doc"], T.StructField("__symbols", T.LongType()),
                           T.StructField("__h", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = WordCache(len(m.languages))
        for batch in words.slices(batches, "text", SLICE_BYTES):
            symbols, bits = text_bits(batch.column("text"), m, cache)
            h = bits / np.maximum(symbols, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(symbols), pa.array(list(h), pa.list_(pa.float64()))], ["doc", "__symbols", "__h"])

    return packed.mapInArrow(run, schema).select(*[F.col("doc")[c].alias(c) for c in keep], "__symbols", "__h")


class WordCache:
    """Bits of words that a worker has scored, as sorted hashes; past its bound it starts anew."""

    def __init__(self, width: int, bound: int = CACHED_WORDS):
        self.bound = bound
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros((0, width))

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the cache, whether each of the sorted keys is there)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, bits: np.ndarray) -> None:
        if len(self.keys) > self.bound:
            self.keys, self.bits = keys, bits
            return
        where = np.searchsorted(self.keys, keys)
        self.keys, self.bits = np.insert(self.keys, where, keys), np.insert(self.bits, where, bits, axis=0)


def text_bits(column: pa.Array, model: Models, cache: WordCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(predicted symbols, bits per language) of every row."""
    column = pc.utf8_lower(pc.fill_null(column, ""))
    rows = len(column)
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data, _ = words.utf8(column)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    width = len(model.languages)
    offsets = np.concatenate(([0], np.cumsum(size)))
    letter = letter_table()[codes]
    if not letter.any():
        return np.zeros(rows, np.int64), np.zeros((rows, width))
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(letter & (~np.concatenate(([False], letter[:-1])) | edge[:-1]))
    end = np.flatnonzero(letter & (~np.concatenate((letter[1:], [False])) | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    length = end - start
    # Every different word is scored once.
    first = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max()), _RADIX, np.uint64))))
    hashed = np.add.reduceat((codes[np.repeat(start, length) + inner].astype(np.uint64) + np.uint64(7)) * power[inner], first)
    keys, some, which = np.unique(words.mix(hashed ^ length.astype(np.uint64)), return_index=True, return_inverse=True)
    cache = cache or WordCache(width)
    at, known = cache.split(keys)
    word_bits = np.empty((len(keys), width))
    word_bits[known] = cache.bits[at[known]]
    new = some[~known]
    if len(new):
        n = length[new] + 2
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        flat = np.zeros(len(place), np.uint32)
        middle = (place > 0) & (place < np.repeat(n, n) - 1)
        flat[middle] = codes[(np.repeat(start[new], n) + place - 1)[middle]]
        flat[begin] = ord(BEGIN)
        flat[begin + n - 1] = ord(END)
        word_bits[~known] = np.add.reduceat(model.surprise(flat, place), begin, axis=0)
        cache.add(keys[~known], word_bits[~known])
    symbols = np.bincount(row, weights=length + 1, minlength=rows).astype(np.int64)
    bits = np.stack([np.bincount(row, weights=word_bits[which, j], minlength=rows) for j in range(width)], 1)
    return symbols, bits


def identify(docs: DataFrame, model: Models, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` and ``rejected``."""
    if not model.languages:
        return docs.select(*[docs[f"`{c}`"] for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"))
    array = lambda x: F.array(*[F.lit(float(v)) for v in x])
    seen = entropies(docs, model, keep, text).withColumn("__best", F.array_min("__h"))
    at = F.array_position("__h", F.col("__best")).cast("int")
    # Short texts scatter more: their spread goes with the root of their length. What lies nearer to the
    # language's mean than to pure chance is never rejected.
    mean = F.element_at(array(model.mean), at)
    allowed = F.greatest((mean + float(np.log2(model.symbols))) / 2, mean + 12 * F.element_at(array(model.spread), at) * (
        1 + 10 / F.sqrt(F.greatest(F.col("__symbols"), F.lit(1)))))
    lettered = F.col("__symbols") > 0
    return seen.select(
        *keep, F.when(lettered, F.element_at(F.array(*map(F.lit, model.languages)), at)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, _softmax(F.col("__best"), model.temperature)).otherwise(0.0).alias("score"),
        (~lettered | (F.col("__best") > allowed)).alias("rejected"))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by a hash of its id's text: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def accepted(docs: DataFrame, model: Models, text: str = "text") -> DataFrame:
    """The documents, with their own columns, that are not rejected."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__doc"), docs[f"`{text}`"].alias("__body"))
    return identify(packed, model, ["__doc"], "__body").where("not rejected").select(
        *[F.col("__doc")[c].alias(c) for c in docs.columns])
