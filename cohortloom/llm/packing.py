"""Order-preserving packing of tokenized documents into fixed windows by dynamic programming.

The tokens of a partition's documents, in their stored order, form one stream. Windows of at most
``window`` tokens are cut at document ends, at ends of sentences or clauses or, where those are further
apart than a window, inside them. The cuts minimise padding plus a penalty per cut document. With f(i) the cost up
to boundary i, f(j) = min over i within one window of (f(i) + pos(i)) + window - pos(j) + penalty(j),
a sliding minimum that a monotone queue keeps in constant time per boundary.

Each partition is packed on its own, in one pass and without a shuffle; long streams are solved in
blocks whose last window is carried into the next block. What is left at the end of a partition is one
padded window, or windows of power-of-two lengths (which need no padding) where that costs less.

NULL text is an empty document: it holds its end id only. Repeated rows are packed each, an empty
table gives no pieces, and other columns of the documents are not read, whatever their names are.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.llm import vocab, words

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 18
SLICE_BYTES = 6 << 20  # text tokenized at a time; what repeats in it is tokenized once
SENTENCE_CUT = 8      # penalty, in tokens of padding, for going on with a document in the next window
CLAUSE_CUT = 16       # the same where only a clause ends
INNER_CUT = 128       # the same for a cut inside a clause

INSIDE, CLAUSE, SENTENCE, DOCUMENT = 0, 1, 2, 3
PENALTY = np.array([INNER_CUT, CLAUSE_CUT, SENTENCE_CUT, 0])


def boundaries(length: int, document_ends: np.ndarray, breaks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) where windows may be cut, from 0 to ``length``, no two further apart than a
    window. ``breaks``: CLAUSE or SENTENCE for every token after which one ends."""
    kind = np.zeros(length + 1, np.int8)
    kind[1:] = breaks
    kind[document_ends] = DOCUMENT
    kind[[0, length]] = np.where(kind[[0, length]] == 0, SENTENCE, kind[[0, length]])
    at = np.flatnonzero(kind)
    gap = np.diff(at)
    far = np.flatnonzero(gap > window)
    extra = [np.arange(at[i] + window, at[i + 1], window) for i in far]
    if extra:
        at = np.sort(np.concatenate([at, *extra]))
    return at, kind[at]


def best_cuts(at: np.ndarray, kind: np.ndarray, window: int) -> np.ndarray:
    """Indices into ``at`` of the cheapest cuts from the first boundary to the last."""
    step = (window - at + PENALTY[kind]).tolist()
    pos = at.tolist()
    back = [0] * len(pos)
    value = [0] * len(pos)  # f(i) + pos(i)
    queue: deque[int] = deque([0])
    value[0] = pos[0]
    for j in range(1, len(pos)):
        low = pos[j] - window
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        here = value[i] + step[j] + pos[j]
        value[j] = here
        while queue and value[queue[-1]] > here:
            queue.pop()
        queue.append(j)
    cuts = [len(pos) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return np.array(cuts[::-1], np.int64)


def tail_cuts(length: int, window: int) -> list[int]:
    """Cuts of the last window: none, or after power-of-two lengths where padding would cost more."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    if length == window or window - length <= SENTENCE_CUT * len(parts):
        return [length]
    return np.cumsum(parts).tolist()


class _Stream:
    """The open tokens of one partition and the documents they belong to."""

    def __init__(self, window: int, first_sequence: int, with_ids: bool):
        self.window, self.next_sequence, self.with_ids = window, first_sequence, with_ids
        self.ids = np.zeros(0, np.uint32)
        self.breaks = np.zeros(0, np.int8)   # what ends after this token
        self.doc_end = np.zeros(0, np.int64)  # stream places where documents end
        self.doc_row: list = []
        self.doc_size = np.zeros(0, np.int64)

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray, breaks: np.ndarray) -> None:
        self.doc_end = np.concatenate([self.doc_end, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.breaks = np.concatenate([self.breaks, breaks])
        self.doc_row += names
        self.doc_size = np.concatenate([self.doc_size, sizes])

    def pieces(self, final: bool) -> dict[str, list] | None:
        if not len(self.ids):
            return None
        at, kind = boundaries(len(self.ids), self.doc_end, self.breaks, self.window)
        ends = at[best_cuts(at, kind, self.window)][1:]
        if final:
            start = int(ends[-2]) if len(ends) > 1 else 0
            ends = np.concatenate([ends[:-1], start + np.array(tail_cuts(int(ends[-1]) - start, self.window))])
        elif len(ends) < 2:
            return None
        else:
            ends = ends[:-1]
        return self._emit(ends.astype(np.int64))

    def _emit(self, ends: np.ndarray) -> dict[str, list]:
        done = int(ends[-1])
        stop = np.union1d(ends, self.doc_end[self.doc_end <= done])
        start = np.concatenate([[0], stop[:-1]])
        doc = np.searchsorted(self.doc_end, start, "right")
        seq = np.searchsorted(ends, start, "right")
        raw = self.ids.astype("<u4").tobytes()
        out = {
            "doc_id": [self.doc_row[d] for d in doc.tolist()],
            "start": start - (self.doc_end[doc] - self.doc_size[doc]),
            "length": stop - start,
            "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)],
            "doc_tokens": self.doc_size[doc],
            "sequence_id": self.next_sequence + seq,
            "offset": start - np.concatenate([[0], ends])[seq],
        }
        if self.with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([start, [done]]).astype(np.int32)),
                                                  pa.array(self.ids[:done].astype(np.int32)))
        self.next_sequence += len(ends)
        gone = int(np.searchsorted(self.doc_end, done, "right"))
        self.ids, self.breaks = self.ids[done:].copy(), self.breaks[done:].copy()
        self.doc_end, self.doc_size = self.doc_end[gone:] - done, self.doc_size[gone:]
        self.doc_row = self.doc_row[gone:]
        return out


def break_marks(tokenizer: str) -> np.ndarray:
    """CLAUSE or SENTENCE for every id of a vocabulary file whose token ends one; read once, on the driver."""
    entries = vocab.entries(tokenizer)
    marks = np.zeros(max(entries.values()) + 1, np.int8)
    for token, i in entries.items():
        signs = token.removesuffix("</w>")
        if not any(c.isalnum() for c in signs):
            marks[i] = SENTENCE if set(signs) & set(".!?") else CLAUSE if set(signs) & set(",;:") else INSIDE
    return marks


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", with_ids: bool = False, cached_pieces: int = vocab.CACHED_PIECES,
         slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``sequence_id`` holds the partition above its 40 low bits, so ids need no pass over all data.
    ``cached_pieces`` bounds what a worker remembers of tokenized pieces and ``slice_bytes`` the text that it works on at a
    time; the result depends on neither.
    """
    shared, marks = vocab.share(docs.sparkSession, tokenizer), break_marks(tokenizer)
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[
        T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocab.encoder(shared, cached_pieces)
        stream = _Stream(window, TaskContext.get().partitionId() << 40, with_ids)

        def table(out):
            names = out.keys()
            return pa.RecordBatch.from_arrays([
                out[c] if isinstance(out[c], pa.Array) else pa.array(out[c], kinds[c]) for c in names], list(names))

        kinds = {c: pa.int64() for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for batch in words.slices(batches, "text", slice_bytes):
            kinds["doc_id"] = batch.schema.field("doc_id").type
            ids, sizes = enc.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)  # the end id follows the ids of its document
            stream.add(batch.column("doc_id").to_pylist(), ids, sizes + 1, marks[ids])
            if len(stream.ids) >= BLOCK_TOKENS and (out := stream.pieces(final=False)):
                yield table(out)
        if out := stream.pieces(final=True):
            yield table(out)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
