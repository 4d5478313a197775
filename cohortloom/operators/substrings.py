"""Which texts hold one of many keys: rolling hashes of whole texts against the hashes of the keys' beginnings.

Keys are grouped by the power of two below their length; a key's beginning of that length is known by its hash. One pass
over a text gives the hashes of all its cuts of a length from running sums, so a text of n characters costs n steps per
group of lengths (31 at most), and only where a cut's hash is that of a beginning is the key itself compared in place.
Texts stay where they are: keys are sent to the tasks in blocks of a checked size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

BLOCK_BYTES = 16 << 20    # keys that are sent to the tasks at a time
SLICE_CHARS = 1 << 20     # characters that are hashed at a time; a longer text is a slice of its own

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2 ** 64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64))))[:n]


class Keys:
    """A block of keys by the length and hash of their beginnings."""

    def __init__(self, keys: list[str]):
        by_width: dict[int, dict[int, list[str]]] = {}
        for key in keys:
            width = 1 << (len(key).bit_length() - 1)
            start = _codes(key[:width])
            value = int((start * _powers(BASE, width)).sum(dtype=np.uint64))
            by_width.setdefault(width, {}).setdefault(value, []).append(key)
        self.groups = {}
        for width, of in sorted(by_width.items()):
            order = sorted(of)
            self.groups[width] = np.array(order, np.uint64), [of[v] for v in order]

    def hits(self, texts: list[str]) -> np.ndarray:
        """Whether each text holds a key."""
        out, first = np.zeros(len(texts), bool), 0
        while first < len(texts):
            stop, size = first + 1, len(texts[first])
            while stop < len(texts) and size + len(texts[stop]) <= SLICE_CHARS:
                size += len(texts[stop])
                stop += 1
            out[first:stop] = self._slice(texts[first:stop])
            first = stop
        return out

    def _slice(self, texts: list[str]) -> np.ndarray:
        size = np.array([len(t) for t in texts])
        end, n = np.cumsum(size), int(size.sum())
        codes = _codes("".join(texts))
        total = np.concatenate(([np.uint64(0)], np.cumsum(codes * _powers(BASE, n))))
        back = _powers(INVERSE, n)
        owner = np.repeat(np.arange(len(texts)), size)
        hit = np.zeros(len(texts), bool)
        for width, (values, keys) in self.groups.items():
            # Cuts that end inside their text, of texts without a hit so far.
            at = np.arange(max(n - width + 1, 0))
            at = at[(at + width <= end[owner[at]]) & ~hit[owner[at]]]
            cut = (total[at + width] - total[at]) * back[at]
            where = np.minimum(np.searchsorted(values, cut), len(values) - 1)
            found = np.flatnonzero(values[where] == cut)
            for place, group in zip(at[found].tolist(), where[found].tolist(), strict=True):
                t = owner[place]
                if not hit[t]:
                    inside = place - int(end[t] - size[t])
                    hit[t] = any(texts[t].startswith(key, inside) for key in keys[group])
        return hit


def _holds(block: Keys, df: DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        out = np.zeros(len(texts), bool)
        out[known] = shared.value.hits(texts[known].tolist())
        return pd.Series(out)

    return holds


def containing(df: DataFrame, col: str, keys: DataFrame, key: str, block_bytes: int | None = None) -> DataFrame:
    """Rows of ``df`` whose text holds some key; NULL texts and keys hold and match nothing, the empty key is in every text.

    Keys of one block are a filter on the rows where they lie. More keys are tried block after block on the distinct
    texts, written once, and the rows are those of the texts that were found.
    """
    limit = block_bytes or BLOCK_BYTES
    words = keys.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    size = words.agg(F.sum(F.octet_length("_key") + 8).alias("b"), F.min(F.length("_key")).alias("least")).first()
    if size["b"] is None:
        return df.limit(0)
    if size["least"] == 0:
        return df.where(F.col(col).isNotNull())
    blocks = -(-size["b"] // limit)
    if blocks == 1:
        block = Keys([row[0] for row in words.collect()])
        return df.where(_holds(block, df)(F.col(col)))
    words = materialise(words, "keys")
    texts = materialise(df.select(F.col(col).alias("_text")).where(F.col(col).isNotNull()).distinct(), "texts")
    found = None
    for b in range(blocks):
        block = Keys([row[0] for row in words.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b).collect()])
        part = materialise(texts.where(_holds(block, df)(F.col("_text"))), "found")
        found = part if found is None else found.union(part)
    return df.join(found.distinct(), F.col(col) == F.col("_text"), "left_semi")
