"""Token ids of whole texts from a public tokenizer file, for Arrow text columns.

The vocabulary file is read once on the driver and sent to the tasks (a file of about 2 MB, checked),
so only the driver needs its path. Texts are cut into pieces at blanks and between ASCII letters or
digits and ASCII punctuation, where no token of a pre-tokenizer that splits letters, digits, blanks
and punctuation can reach across; each different piece of a slice is tokenized once.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from cohortloom.llm import words

MAX_VOCABULARY_BYTES = 16 << 20
CACHED_PIECES = 600_000  # pieces kept per worker; past that the cache starts anew, with the same results
CACHED_LENGTH = 32

BLANK, PLAIN, OTHER, PUNCTUATION = 0, 1, 2, 3
_KIND = np.full(256, PUNCTUATION, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = PLAIN
_KIND[128:] = _KIND[:9] = _KIND[14:32] = OTHER  # never cut next to these, nor next to an apostrophe
_KIND[[39, 127]] = OTHER

_loaded: dict[int, Encoder] = {}


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file as a broadcast value, after a check of its size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(text)


class Encoder:
    """Tokenizer with a bounded cache of pieces. One per Python worker."""

    def __init__(self, text: str, cached: int = CACHED_PIECES):
        # A task has one core: the library's own threads would only wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        self.cached = cached

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        known = self.cache
        found = list(map(known.get, pieces))
        new = [i for i, v in enumerate(found) if v is None]
        if len(known) > self.cached:
            known.clear()
        for i, e in zip(new, self.tokenizer.encode_batch_fast([pieces[i] for i in new], add_special_tokens=False),
                        strict=True):
            found[i] = array("I", e.ids).tobytes()
            if len(pieces[i]) <= CACHED_LENGTH:
                known[pieces[i]] = found[i]
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per row) of a string column; NULL is empty."""
        data, offsets = words.utf8(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        kind = _KIND[data]
        left, right = kind[:-1], kind[1:]
        bound = np.zeros(len(data) + 1, bool)
        bound[1:-1] = (((left == BLANK) != (right == BLANK)) | ((left == PLAIN) & (right == PUNCTUATION))
                       | ((left == PUNCTUATION) & (right == PLAIN)))
        bound[offsets] = True
        # A text that may hold a special string is one piece.
        whole = np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False))
        for r in whole:
            bound[offsets[r] + 1:offsets[r + 1]] = False
        at = np.flatnonzero(bound)
        row = np.searchsorted(offsets, at[:-1], "right") - 1
        keep = (kind[at[:-1]] != BLANK) | np.isin(row, whole)
        pieces = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
        coded = pc.dictionary_encode(pieces.filter(pa.array(keep)))
        found = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = coded.indices.to_numpy(zero_copy_only=False)
        per_row = np.bincount(row[keep], weights=size[code], minlength=rows).astype(np.int64)
        # Gather the ids of every piece: its place in the flat table of different pieces, plus 0, 1, ...
        table = np.frombuffer(b"".join(found), np.uint32)
        first = np.cumsum(size) - size
        length = size[code]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(first[code] - (ends - length), length)
        return table[place], per_row


def encoder(shared: Broadcast, cached: int = CACHED_PIECES) -> Encoder:
    """The worker's encoder for a shared vocabulary."""
    key = hash((shared.value, cached))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(shared.value, cached)
    return _loaded[key]


def entries(path: str) -> dict[str, int]:
    """Token texts and ids of a vocabulary file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab()
