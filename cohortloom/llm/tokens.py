"""Token counts by a compiled finite-state transducer.

The byte-level pair-merge tokenizer is compiled to a deterministic transducer over bytes. A state holds where the
pre-tokenizer stands in its pattern and, for the open piece of text, the tokens that the merges would give for it and
for its prefixes that can still be extended; every transition carries by how much the token count changes. The
transducer is built as bytes ask for it and kept as two tables (next state, count change) per worker.

Texts are cut into chunks that run side by side, one table look-up per byte for all of them. Where a chunk has a
change from text to blank, its state map is constant behind that place: it maps every start state to the same end.
So each chunk is run from its first such place on, the maps are composed by a prefix scan over the chunks of a text,
and the heads of the chunks run from the states that the scan gives them.

Counts are those of the library for whole texts, without added tokens. A special string inside a text is one token,
as by the library's default. NULL is empty: 0 bytes and 0 tokens. Repeated rows are counted each; an empty table gives
an empty result; other columns are kept by name only where asked for.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import vocab, words

LIMIT = 512
CHUNK_BYTES = 256
MAX_STATES = 200_000   # per worker; past that the tables are built anew, with the same results
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def byte_symbols() -> dict[str, int]:
    """The vocabulary's printable stand-in of every byte: printable Latin-1 characters stand for themselves, the
    others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The pair merges: tokens as bytes, their encodings, and which tokens may follow each other."""

    def __init__(self, text: str):
        spec = json.loads(text)
        stand_in = byte_symbols()
        raw = lambda s: bytes(stand_in[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        special = set(self.specials)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[raw(a), raw(b)] = i
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if s not in special}
        self.prefixes = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self._whole: dict[bytes, bool] = {}
        self._pair: dict[tuple[bytes, bytes], bool] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Merge by rank until nothing merges."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(pair[0] + pair[1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether a token's own bytes encode to itself."""
        if token not in self._whole:
            self._whole[token] = self.encode(token) == [token]
        return self._whole[token]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart when they are next to each other."""
        if (left, right) not in self._pair:
            self._pair[left, right] = self.encode(left + right) == [left, right]
        return self._pair[left, right]


# A state of the open piece: the last token of the encoding of each prefix that ends where a token of the whole piece
# may still begin, as (bytes since that place, last token before it, count before it less the count of the piece now).
EMPTY = ((b"", b"", 0),)


def extend(merges: Merges, open_piece: tuple, byte: int) -> tuple[tuple, int]:
    """One more byte of a piece: (new state, change of the token count).

    The encoding of a prefix ends in the one token that is its suffix, encodes to itself and stays apart from the last
    token of what is before it.
    """
    step = bytes([byte])
    grown = [(tail + step, last, back) for tail, last, back in open_piece]
    found = None
    for tail, last, back in grown:  # longest suffix first
        if tail in merges.tokens and merges.whole(tail) and (not last or merges.fits(last, tail)):
            found = (tail, back + 1)
            break
    if found is None:
        raise ValueError(f"byte {byte} is in no token")
    token, change = found
    kept = [(tail, last, back - change) for tail, last, back in grown if tail in merges.prefixes]
    return (*kept, (b"", token, 0)), change


START, LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(7)
_CLASS = {"L": LETTER, "N": NUMBER}
_BLANKS = {0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def char_class(char: str) -> int:
    if ord(char) in _BLANKS:
        return SPACE if char == " " else BLANK
    return _CLASS.get(unicodedata.category(char)[0], OTHER)


class Transducer:
    """Pre-tokenizer and merges as one machine over bytes, built on demand.

    A state is (mode, open piece, blanks, pending bytes). The mode is the class of the open piece, or QUOTE with the
    letters so far where an apostrophe began it. ``blanks`` is (piece before the last blank, count change of the last
    blank, whether it was a space) within a run of blanks, since its last blank may belong to what follows.
    """

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.column = np.full(256, -1, np.int64)  # of the tables, for the bytes that occur
        self.next = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int8)
        self.start = self.state_of((START, EMPTY, None, b""))
        # Behind a blank that follows other text nothing before it matters.
        self.after_blank = np.full(256, -1, np.int32)
        self.admit(np.array([9, 10, 11, 12, 13, 32]))
        for b in (9, 10, 11, 12, 13, 32):
            self.after_blank[b] = self.step(self.start, b)[0]

    def state_of(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return self.number[state]

    def admit(self, seen: np.ndarray) -> None:
        """Give every byte that occurs a column."""
        new = seen[self.column[seen] < 0]
        used = int(self.column.max()) + 1
        self.column[new] = np.arange(used, used + len(new))
        while self.next.shape[1] < used + len(new):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
            self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)

    def step(self, state: int, byte: int) -> tuple[int, int]:
        at = state, self.column[byte]
        if self.next[at] < 0:
            new, change = self.follow(self.states[state], byte)
            number = self.state_of(new)
            self.next[at], self.change[at] = number, change
        return int(self.next[at]), int(self.change[at])

    def follow(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The definition of a transition."""
        mode, piece, blanks, pending = state
        raw = pending + bytes([byte])
        lead = raw[0]
        need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if len(raw) < need:
            return (mode, piece, blanks, raw), 0
        kind = char_class(raw.decode())
        return self.read(mode, piece, blanks, raw, kind)

    def grow(self, piece: tuple, raw: bytes) -> tuple[tuple, int]:
        total = 0
        for b in raw:
            piece, change = extend(self.merges, piece, b)
            total += change
        return piece, total

    def read(self, mode, piece, blanks, raw: bytes, kind: int) -> tuple[tuple, int]:
        if isinstance(mode, tuple):  # an apostrophe that may begin a contraction, with its letters so far
            letters = mode[1] + raw
            if letters in CONTRACTIONS:
                _, change = self.grow(piece, raw)
                return (START, EMPTY, None, b""), change
            if any(c.startswith(letters) for c in CONTRACTIONS):
                grown, change = self.grow(piece, raw)
                return ((QUOTE, letters), grown, None, b""), change
            if not mode[1]:  # the apostrophe alone: as any other sign
                return self.read(OTHER, piece, None, raw, kind)
            # "'r", "'v" or "'l" and no contraction: the apostrophe is a piece, the letter begins the next.
            alone, _ = self.grow(EMPTY, mode[1])
            _, both = self.grow(EMPTY, b"'" + mode[1])
            _, sign = self.grow(EMPTY, b"'")
            _, letter = self.grow(EMPTY, mode[1])
            new, change = self.read(LETTER, alone, None, raw, kind)
            return new, change + sign + letter - both
        if kind in (SPACE, BLANK):
            if mode in (SPACE, BLANK):
                grown, change = self.grow(piece, raw)
                return (kind, grown, (piece, change, raw), b""), change
            grown, change = self.grow(EMPTY, raw)
            return (kind, grown, (EMPTY, change, raw), b""), change
        back = 0
        if mode in (SPACE, BLANK):
            # The run's last blank leaves it: a space joins what follows, any other blank is a piece of its own.
            before, last, blank = blanks
            back = -last
            if mode == SPACE:
                grown, change = self.grow(EMPTY, b" " + raw)
                return (kind, grown, None, b""), back + change
            _, own = self.grow(EMPTY, blank)
            back += own
        elif mode == kind:
            grown, change = self.grow(piece, raw)
            return (kind, grown, None, b""), change
        grown, change = self.grow(EMPTY, raw)
        return ((QUOTE, b"") if raw == b"'" else kind, grown, None, b""), back + change

    def run(self, state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run lanes of bytes side by side: (end states, count changes)."""
        state, total = state.astype(np.int32), np.zeros(len(state), np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first: finished lanes are at the back
        left = (end - begin)[order]
        at, live = begin[order], state[order]
        got = np.zeros(len(order), np.int64)
        n = len(order)
        step = 0
        while True:
            n = int(np.searchsorted(-left[:n], -step, "left"))
            if not n:
                break
            byte = data[at[:n] + step]
            column = self.column[byte]
            new = self.next[live[:n], column]
            if (new < 0).any():
                for s, b in set(zip(live[:n][new < 0].tolist(), byte[new < 0].tolist(), strict=True)):
                    self.step(s, b)
                new = self.next[live[:n], column]
            got[:n] += self.change[live[:n], column]
            live[:n] = new
            step += 1
        state[order], total[order] = live, got
        return state, total

    def counts(self, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK_BYTES) -> np.ndarray:
        """Token counts of the texts."""
        if len(self.states) > self.max_states:
            self.reset()
        self.admit(np.flatnonzero(np.bincount(data, minlength=256)))
        rows = len(offsets) - 1
        size = np.diff(offsets)
        pieces = -(-size // chunk)
        row = np.repeat(np.arange(rows), pieces)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[row] + inner * chunk
        end = np.minimum(begin + chunk, offsets[row + 1])
        if not len(row):
            return np.zeros(rows, np.int64)
        # The first blank behind other text in each chunk: from there on its map is constant.
        blank = ~words.NON_BLANK[data]
        sync = np.flatnonzero(blank[1:] & ~blank[:-1] & (data[:-1] < 0x80)) + 1
        where = np.searchsorted(sync, begin + 1)
        found = np.where(where < len(sync), sync[np.minimum(where, max(len(sync) - 1, 0))] if len(sync) else 0, 1 << 62)
        constant = found < end
        head_end = np.where(constant, found, end)
        after = np.zeros(len(row), np.int32)
        total = np.zeros(len(row), np.int64)
        c = np.flatnonzero(constant)
        # A blank behind other text closes a piece and opens a run, with the count of a run of one.
        opening = self.after_blank[data[head_end[c]]]
        after[c], total[c] = self.run(opening, data, head_end[c] + 1, end[c])
        total[c] += self.change[self.start, self.column[data[head_end[c]]]]
        # Prefix scan: a chunk's start state is the end of the last constant map before it, run over the heads between.
        start = np.full(len(row), -1, np.int32)
        start[inner == 0] = self.start
        known = np.flatnonzero(constant[:-1] & (inner[1:] > 0))
        start[known + 1] = after[known]
        while True:
            ready = np.flatnonzero((start >= 0) & (head_end >= 0))
            if not len(ready):
                break
            state, change = self.run(start[ready], data, begin[ready], head_end[ready])
            total[ready] += change
            head_end[ready] = -1
            onward = ready[(~constant[ready]) & (ready + 1 < len(row))]
            onward = onward[inner[onward + 1] > 0]
            end_state = np.zeros(len(row), np.int32)
            end_state[ready] = state
            start[onward + 1] = end_state[onward]
        return np.bincount(row, weights=total, minlength=rows).astype(np.int64)


_machines: dict[int, Transducer] = {}


def machine(shared) -> Transducer:
    """The worker's transducer for a shared vocabulary."""
    key = hash(shared.value)
    if key not in _machines:
        _machines.clear()
        _machines[key] = Transducer(Merges(shared.value))
    return _machines[key]


def counted(column: pa.Array, transducer: Transducer) -> np.ndarray:
    """Token counts of a text column, special strings as one token each."""
    data, offsets = words.utf8(column)
    raw = data.tobytes()
    specials = [s.encode() for s in transducer.merges.specials if s]
    if not any(s in raw for s in specials):
        return transducer.counts(data, offsets)
    # The text around a special string is tokenized on its own.
    import re

    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))
    parts, owner, extra = [], [], np.zeros(len(offsets) - 1, np.int64)
    for r in range(len(offsets) - 1):
        split = pattern.split(raw[offsets[r]:offsets[r + 1]])
        extra[r] = len(split) - 1
        parts += split
        owner += [r] * len(split)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    part_counts = transducer.counts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(sizes))))
    return extra + np.bincount(owner, weights=part_counts, minlength=len(extra)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer: str, keep: list[str], limit: int = LIMIT, text: str = "text") -> DataFrame:
    """The kept columns with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    shared = vocab.share(docs.sparkSession, tokenizer)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("doc"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType([packed.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = machine(shared)
        for batch in words.slices(batches, "text"):
            column = batch.column("text")
            _, offsets = words.utf8(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.diff(offsets)), pa.array(counted(column, transducer))],
                ["doc", "n_bytes", "n_tokens"])

    return packed.mapInArrow(run, schema).select(*[F.col("doc")[c].alias(c) for c in keep], "n_bytes", "n_tokens",
                                                 (F.col("n_tokens") > limit).alias("over_limit"))
