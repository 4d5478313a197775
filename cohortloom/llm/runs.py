"""Periodic runs of words: stretches that repeat their own beginning, found by a suffix automaton with link-cut access.

A run is a longest stretch of words with smallest period q (words q apart are equal) of at least ``MIN_LENGTH`` words and
``MIN_CYCLES`` periods. For every word in turn, the automaton's state of the text so far is accessed in the tree of
suffix links: the path to the root falls into segments that were last coloured at the same earlier place, the last
end of those suffixes, and is recoloured with the new place. If the distance of the two ends is no more than the longest
suffix of a segment, that suffix and the distance make a square; as the earlier end is the last one, the distance is
its smallest period and the suffix reaches as far to the left as the period does. A run is the squares of one beginning
and one period at consecutive places. Link-cut access keeps recolouring at a logarithm per word, however periodic the
text is.

Before that, words that cannot lie in a run are left out without loss: inside a run every window of ``window_words``
words occurs again, so a run lies in a stretch of words whose windows all occur twice in the document (and, looked
at again, in the stretch itself). Words are compared by 64-bit hashes.

Documents are worked on one by one in Arrow batches, without a shuffle; whole texts count, and memory goes with the
longest stretch of one document. NULL and blank texts have no words and no runs and collapse to an empty text.
Rows are independent, so repeated ids do no harm; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm import words

MIN_LENGTH, MIN_CYCLES = 24, 3

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_COEF = np.random.default_rng(12_012).integers(1, 2**64, 8, dtype=np.uint64) | np.uint64(1)


def window_words(length: int, cycles: int) -> int:
    """Words of a window that occurs at least twice in any run of so many words and cycles, 8 at most."""
    if cycles < 2:
        raise ValueError("a run has two cycles at least")
    return min(8, length * (cycles - 2) // cycles + 1)


class LinkCutTree:
    """The tree of suffix links, cut into paths of one colour each; a path is a splay tree ordered by depth.

    The colour of a path is kept at the root of its splay tree and handed on when another node becomes the root.
    """

    def __init__(self, links: list[int]):
        self.up = links
        self.left, self.right = [-1] * len(links), [-1] * len(links)
        self.colour = [-1] * len(links)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                tint = colour[g]
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            else:
                tint = colour[p]
            self._rotate(x)
            colour[x] = tint

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from ``node`` to the root; (deepest node, colour so far) of each segment it had."""
        up, right, tint = self.up, self.right, self.colour
        segments, x, below = [], node, -1
        while x >= 0:
            self._splay(x)
            old = tint[x]
            if old >= 0:
                segments.append((x, old))
            if right[x] >= 0:
                tint[right[x]] = old  # what hangs deeper stays a path of its own
            right[x] = below
            below, x = x, up[x]
        tint[below] = colour
        self._splay(node)
        return segments


def suffix_automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, longest length of every state, state of every prefix)."""
    step: list[dict[int, int]] = [{}]
    link, length, state, last = [-1], [0], [], 0
    for c in text:
        new = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                half = len(link)
                step.append(step[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = half
                    p = link[p]
                link[q] = link[new] = half
        last = new
        state.append(new)
    return link, length, state


def runs_of(text: list[int], length: int = MIN_LENGTH, cycles: int = MIN_CYCLES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    link, longest, state = suffix_automaton(text)
    tree = LinkCutTree(link)
    found: list[tuple[int, int, int]] = []
    going: dict[int, tuple[int, int]] = {}  # period -> (start, last place)

    def close(period: int, start: int, end: int) -> None:
        if end - start + 1 >= max(length, cycles * period):
            found.append((start, end - start + 1, period))

    for i, node in enumerate(state):
        for deepest, before in tree.access(node, i):
            period, suffix = i - before, longest[deepest]
            if period <= suffix:
                start = i - suffix - period + 1
                if period in going:
                    first, end = going[period]
                    if first != start or end != i - 1:
                        close(period, first, end)
                going[period] = (start, i)
    for period, (start, end) in going.items():
        close(period, start, end)
    return sorted(found, key=lambda r: (r[0], r[2]))


def recurring(value: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of stretches inside a group whose windows of ``size`` values all occur twice or more in the group."""
    m = len(value) - size + 1
    none = np.zeros(0, np.int64)
    if m < 1:
        return none, none
    total = words.mix(group[:m].astype(np.uint64) + np.uint64(1))
    for j in range(size):
        total += words.mix(value[j:m + j] + np.uint64(j)) * _COEF[j]
    whole = np.flatnonzero(group[:m] == group[size - 1:])
    total = total[whole]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    twice = np.zeros(len(total), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = whole[twice]
    if not len(at):
        return none, none
    gap = np.flatnonzero((np.diff(at) > 1) | (group[at[1:]] != group[at[:-1]]))
    return at[np.concatenate(([0], gap + 1))], at[np.concatenate((gap, [len(at) - 1]))] + size


def row_runs(value: np.ndarray, row: np.ndarray, first: np.ndarray, length: int, cycles: int) -> dict[int, list]:
    """Runs per row of a slice: ``value`` and ``row`` of every word, ``first`` the place of every row's first word."""
    size = window_words(length, cycles)
    start, end = recurring(value, row, size)
    while len(start):
        # Once more inside the stretches, as the other copy of a window may lie elsewhere in the document.
        long = end - start >= length
        start, end = start[long], end[long]
        width = end - start
        ends = np.cumsum(width)
        at = np.repeat(start - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)
        a, b = recurring(value[at], np.repeat(np.arange(len(start)), width), size)
        if len(a) == len(start) and (b - a == width).all():
            break
        start, end = (at[a], at[b - 1] + 1) if len(a) else (a, b)
    out: dict[int, list] = {}
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        text = np.unique(value[a:b], return_inverse=True)[1].tolist()
        r = int(row[a])
        shift = a - int(first[r])
        out.setdefault(r, []).extend((s + shift, n, q) for s, n, q in runs_of(text, length, cycles))
    for found in out.values():
        found.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int,
                    kept: np.ndarray) -> pa.Array:
    """The kept words of every row, joined by one space."""
    start, end, row = start[kept], end[kept], row[kept]
    last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 2, np.int8)  # a kept word takes the blank behind it along
    edge[start] += 1
    edge[np.where(last, end, end + 1)] -= 1
    take = np.cumsum(edge[:len(data)], dtype=np.int8) > 0
    text = data.copy()
    text[end[~last]] = 32
    size = np.bincount(row, weights=(end - start) + ~last, minlength=rows).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[take])))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = MIN_LENGTH,
              cycles: int = MIN_CYCLES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    ``runs``: (start, length, period) in words from 0, by start and period. ``collapsed``: the words without those that
    lie in a run behind its first period, joined by one space.
    """
    window_words(length, cycles)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            data, offsets = words.utf8(batch.column("text"))
            rows = len(offsets) - 1
            start, end, row = words.spans(data, offsets, words.NON_BLANK)
            value = words.hashes(data, start, end, lower=False)
            n = np.bincount(row, minlength=rows)
            first = np.cumsum(n) - n
            found = row_runs(value, row, first, length, cycles)
            kept = np.ones(len(start), bool)
            for r, of in found.items():
                for s, size, q in of:
                    kept[first[r] + s + q:first[r] + s + size] = False
            runs = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in found.get(r, ())]
                             for r in range(rows)], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), runs,
                collapsed_texts(data, start, end, row, rows, kept).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
