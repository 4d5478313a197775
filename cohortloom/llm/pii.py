"""Personal data in whole texts: fixed rules, and a semi-Markov conditional random field that adds what they miss.

The rules (``base_spans``) find e-mail addresses, internet addresses, card and phone numbers of the usual form. The
field labels stretches of a text instead of single tokens: a text is cut into units (runs of letters and digits, single
signs), and a labelling is a sequence of entities of at most ``MAX_UNITS`` units with plain units between them. An entity
is scored as a whole: its digits, runs and separators, checksum, number ranges, brackets, first and last unit and its
neighbours on both sides. A dynamic program over ends and bounded lengths picks boundaries and kinds together; plain
units score 0.

The field is trained here, by gradient steps on the likelihood of whole segmentations (forward and backward sums over
the same lattice): regions with spans of the rules, the same regions written in ways that the rules miss (without
country code, other separators, spelled-out at signs), and look-alikes that are no personal data (broken checksums,
numbers out of range, dates, short numbers). The regions are a bounded sample, ``SAMPLE_REGIONS`` per kind, chosen by
hash among those of all documents; a kind that the corpus does not hold is never added.

Spans of the rules stay as they are; the field decides on the units that they leave free. Places are code points, ends
exclusive. NULL and empty texts have no spans. Rows are independent, repeated ones included; an empty table trains an
empty field and gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.llm import words

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MAX_UNITS = 24          # units of an entity at most
SAMPLE_REGIONS = 400   # regions per kind, and without any, that the field is fitted on
REGION_CHARS = 200      # of at most this length
MARGIN = 1.0            # log odds that an entity must have over plain units to be added
STEPS, RATE, DECAY = 200, 0.2, 3e-5
BLOCK_UNITS = 1 << 14   # begins of candidates that are scored at a time

SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"

# --- the rules ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")  # dotted numbers; every four make a match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(int(d) * 2 - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches, in order; every rule reads a text once, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, EMAIL, done))
        at = text.find("@", max(at + 1, done))
    for m in _CHAIN.finditer(text):
        parts = list(_DIGITS.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                out.append((four[0].start(), IP, four[3].end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# --- units and candidates ----------------------------------------------------------------------------------------

SIGNS = "@.+-_%()[]/:"
# A region is what an entity can lie in: units on one line; a blank joins only digits, brackets, +, - and dots.
REGION = re.compile(r"(?:[^\W_]|[@.+\-_%()\[\]/:])++(?:(?<=[0-9()\[\]+.\-]) (?=[0-9()\[\]+.\-])(?:[^\W_]|[@.+\-_%()\[\]/:])++)*+")
_UNIT = re.compile(r"[\[(]at[\])]|[\[(]dot[\])]|[^\W_]+|.")
_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")

NUMBER, LETTERS, MIXED, PLUS, OPEN, CLOSE, AT, DOT, BLANK, DASH, OTHER = range(11)
_SIGN_CLASS = {"@": AT, "(at)": AT, "[at]": AT, ".": DOT, "(dot)": DOT, "[dot]": DOT, " ": BLANK, "+": PLUS, "(": OPEN, "[": OPEN,
               ")": CLOSE, "]": CLOSE, "-": DASH}
# What stands beside a candidate: nothing or a blank, then these classes.
_BESIDE = {NUMBER: 1, LETTERS: 1, MIXED: 1, DOT: 2, AT: 3, PLUS: 4, DASH: 5, BLANK: 0}

# Template -> number of its values. A candidate has exactly one value of each.
TEMPLATES = {"any": 1, "digits": 14, "numbers": 7, "longest": 9, "shortest": 6, "at": 3, "dots": 5, "letters": 3, "blanks": 5,
             "dashes": 4, "brackets": 3, "plus": 3, "others": 2, "first": 11, "last": 11, "left": 7, "right": 7, "checksum": 3,
             "quad": 3, "dot_after_at": 2, "units": 6}
_OFFSET = dict(zip(TEMPLATES, np.cumsum([0, *TEMPLATES.values()][:-1]).tolist(), strict=True))
N_FEATURES = sum(TEMPLATES.values())


def _steps(width: int, *edges: int) -> np.ndarray:
    return np.searchsorted(edges, np.arange(width), "right").astype(np.int16)


_DIGIT_STEP = _steps(512, 1, 4, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20)
_LONGEST_STEP = _steps(512, 1, 4, 5, 6, 9, 11, 14, 20)
_SHORTEST_STEP = _steps(512, 1, 2, 3, 4, 6)
_UNITS_STEP = _steps(MAX_UNITS + 1, 2, 4, 7, 9, 12)


class Units:
    """Units of regions one after the other. A region is (text, start, end); texts are looked at one character beyond."""

    def __init__(self, regions: list[tuple[str, int, int]]):
        start, end, cls, region, digits, size, value = [], [], [], [], [], [], []
        before, after = [], []
        for r, (text, a, b) in enumerate(regions):
            for m in _UNIT.finditer(text, a, b):
                u = m.group()
                c = _SIGN_CLASS.get(u)
                if c is None:
                    if u.isascii() and u.isdigit():
                        c = NUMBER
                    elif u[0].isalnum():
                        c = MIXED if any("0" <= x <= "9" for x in u) else LETTERS
                    else:
                        c = OTHER
                start.append(m.start())
                end.append(m.end())
                cls.append(c)
                region.append(r)
                d = [ord(x) - 48 for x in u if "0" <= x <= "9"]
                digits += d
                size.append(len(d))
                value.append(int(u) if c == NUMBER and len(u) <= 3 else 1000)
            before.append(self._beside(text[a - 1:a]))
            after.append(self._beside(text[b:b + 1]))
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.cls, self.region = np.array(cls, np.int16), np.array(region, np.int64)
        n = len(start)
        self.edges = np.searchsorted(self.region, np.arange(len(regions) + 1))
        beside = np.array([_BESIDE.get(c, 6) for c in range(11)], np.int16)[self.cls]
        # What stands left and right of every unit.
        self.left, self.right = np.concatenate(([0], beside[:-1])).astype(np.int16)[:n], np.concatenate((beside[1:], [0])).astype(np.int16)[:n]
        some = np.flatnonzero(np.diff(self.edges))
        self.left[self.edges[some]] = np.array(before, np.int16)[some]
        self.right[self.edges[some + 1] - 1] = np.array(after, np.int16)[some]
        self.size, self.value = np.array(size, np.int64), np.array(value, np.int64)
        total = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.digits = total(self.size)
        self.of = {c: total(self.cls == c) for c in range(11)}
        d = np.array(digits, np.int64)
        twice = 2 * d - 9 * (d > 4)
        odd = np.arange(len(d)) % 2 == 1
        self.luhn = total(np.where(odd, twice, d)), total(np.where(odd, d, twice))  # doubled at odd, at even places

    @staticmethod
    def _beside(c: str) -> int:
        if not c or c.isspace():
            return 0
        return 1 if c.isalnum() else _BESIDE.get(_SIGN_CLASS.get(c, OTHER), 6)

    def candidates(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, features) of all entities that may begin at the units from ``first`` up to ``stop``.

        They begin with a letter, digit, + or opening bracket, end with a letter, digit or closing bracket, hold a digit
        or an at sign, and letters only beside an at sign.
        """
        begins, ends, features = [], [], []
        i = np.arange(first, stop)
        i = i[np.isin(self.cls[i], (NUMBER, LETTERS, MIXED, PLUS, OPEN))]
        longest = np.zeros(len(i), np.int64)
        shortest = np.full(len(i), 511, np.int64)
        widest = np.zeros(len(i), np.int64)
        for units in range(1, MAX_UNITS + 1):
            j = i + units - 1
            inside = j < len(self.cls)
            inside[inside] = self.region[j[inside]] == self.region[i[inside]]
            i, j, longest, shortest, widest = (x[inside] for x in (i, j, longest, shortest, widest))
            if not len(i):
                break
            number = self.cls[j] == NUMBER
            longest = np.maximum(longest, np.minimum(self.size[j], 511))
            shortest = np.where(number, np.minimum(shortest, self.size[j]), shortest)
            widest = np.where(number, np.maximum(widest, self.value[j]), widest)
            count = lambda c, i=i, j=j: self.of[c][j + 1] - self.of[c][i]
            digits, at = self.digits[j + 1] - self.digits[i], count(AT)
            letters = count(LETTERS) + count(MIXED)
            ok = np.isin(self.cls[j], (NUMBER, LETTERS, MIXED, CLOSE)) & ((digits > 0) | (at > 0)) & ((letters == 0) | (at > 0))
            if not ok.any():
                continue
            k = np.flatnonzero(ok)
            a, b = i[k], j[k]
            take = lambda c: count(c)[k]  # noqa: E731, B023
            digits, at = np.minimum(digits[k], 511), at[k]
            numbers, dots, opened, closed = take(NUMBER), take(DOT), take(OPEN), take(CLOSE)
            blanks, dashes, plus, other = take(BLANK), take(DASH), take(PLUS), take(OTHER)
            from_, to = self.digits[a], self.digits[b + 1]
            odd, even = self.luhn
            last_even = (to - 1) % 2 == 0
            check = np.where(last_even, odd[to] - odd[from_], even[to] - even[from_]) % 10 == 0
            sized = (digits >= 14) & (digits <= 19)
            plain = (blanks + dashes + plus + other + letters[k]) == 0
            quad = (numbers == 4) & (dots == 3) & plain & (b - a + 1 - opened - closed == 7)
            dotted = np.zeros(len(k), bool)
            with_at = np.flatnonzero(at == 1)
            if len(with_at):
                place = np.searchsorted(self.of[AT], self.of[AT][a[with_at]] + 1) - 1
                dotted[with_at] = self.of[DOT][b[with_at] + 1] > self.of[DOT][place]
            values = {
                "any": np.zeros(len(k), np.int64), "digits": _DIGIT_STEP[digits], "numbers": np.minimum(numbers, 6),
                "longest": _LONGEST_STEP[longest[k]], "shortest": np.where(numbers > 0, _SHORTEST_STEP[np.minimum(shortest[k], 511)], 0),
                "at": np.minimum(at, 2), "dots": np.minimum(dots, 4), "letters": np.minimum(letters[k], 2), "blanks": np.minimum(blanks, 4),
                "dashes": np.minimum(dashes, 3), "brackets": np.where(opened + closed == 0, 0, np.where(opened == closed, 1, 2)),
                "plus": np.where(plus == 0, 0, np.where((plus == 1) & (self.cls[a] == PLUS), 1, 2)), "others": np.minimum(other, 1),
                "first": self.cls[a], "last": self.cls[b], "left": self.left[a], "right": self.right[b],
                "checksum": np.where(sized, np.where(check, 1, 2), 0), "quad": np.where(quad, np.where(widest[k] <= 255, 1, 2), 0),
                "dot_after_at": dotted.astype(np.int64), "units": np.full(len(k), _UNITS_STEP[units])}
            features.append(np.stack([_OFFSET[t] + values[t] for t in TEMPLATES], 1).astype(np.int16))
            begins.append(a)
            ends.append(b + 1)
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(TEMPLATES)), np.int16)
        return np.concatenate(begins), np.concatenate(ends), np.concatenate(features)


# --- the field ---------------------------------------------------------------------------------------------------

def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of every candidate as every kind."""
    out = np.zeros((len(features), weights.shape[1]))
    for t in range(features.shape[1]):
        out += weights[features[:, t]]
    return out


def best_segments(begin: list[int], end: list[int], score: list[float]) -> list[int]:
    """The candidates of the best segmentation: apart from each other, with the highest sum; plain units score 0."""
    order = sorted(range(len(begin)), key=lambda c: (end[c], begin[c]))
    ends, best, back = [-1], [0.0], [(-1, -1)]  # by end: best sum up to it, and how
    for c in order:
        if score[c] <= 0:
            continue
        k = bisect_right(ends, begin[c]) - 1
        total = best[k] + score[c]
        if total > best[-1]:
            if ends[-1] == end[c]:
                best[-1], back[-1] = total, (c, k)
            else:
                ends.append(end[c])
                best.append(total)
                back.append((c, k))
    out, at = [], len(ends) - 1
    while at > 0:
        c, at = back[at]
        out.append(c)
    return out[::-1]


def train(regions: list[tuple[str, int, int]], gold: list[list[tuple[int, int, int]]], steps: int = STEPS) -> np.ndarray:
    """Weights (feature, kind) fitted on regions with their spans (start, kind, end), which must begin and end with units.

    Gradient steps on the mean log likelihood of the whole segmentation, with weight decay.
    """
    weights = np.zeros((N_FEATURES, len(KINDS)))
    units = Units(regions)
    begin, end, features = units.candidates(0, len(units.cls))
    if not len(begin):
        return weights
    region = units.region[begin]
    wanted = {(r, s, e): k for r, spans in enumerate(gold) for s, k, e in spans}
    gold_kind = np.array([wanted.get(key, -1) for key in zip(region.tolist(), units.start[begin].tolist(),
                                                            units.end[end - 1].tolist(), strict=True)])
    # Edge numbers: every region has one more than units.
    b, e = begin + region, end + region
    edges = units.edges
    lengths = np.diff(edges)
    first_edge = edges[:-1] + np.arange(len(lengths))
    local_end, local_begin = end - edges[region], begin - edges[region]
    longest = int(lengths.max())
    steps_at = [first_edge[lengths >= p] + p for p in range(1, longest + 1)]
    by_end = [np.flatnonzero(local_end == p) for p in range(1, longest + 1)]
    from_end = lengths[region] - local_begin
    backward_at = [(first_edge + lengths - p)[lengths >= p] for p in range(1, longest + 1)]
    by_begin = [np.flatnonzero(from_end == p) for p in range(1, longest + 1)]
    kinds, which = np.unique(features, axis=0, return_inverse=True)  # many candidates look alike
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    truth = np.zeros_like(weights)
    some = np.flatnonzero(gold_kind >= 0)
    for t in range(features.shape[1]):
        np.add.at(truth, (features[some, t], gold_kind[some]), 1.0)
    for step in range(1, steps + 1):
        of_kind = scores(kinds, weights)
        score = np.logaddexp.reduce(of_kind, axis=1)[which]
        alpha = np.zeros(int(edges[-1]) + len(lengths))
        for at, cands in zip(steps_at, by_end, strict=True):
            alpha[at] = alpha[at - 1]
            np.logaddexp.at(alpha, e[cands], alpha[b[cands]] + score[cands])
        beta = np.zeros_like(alpha)
        for at, cands in zip(backward_at, by_begin, strict=True):
            beta[at] = beta[at + 1]
            np.logaddexp.at(beta, b[cands], beta[e[cands]] + score[cands])
        z = beta[first_edge][region]
        part = np.bincount(which, weights=np.exp(alpha[b] + beta[e] - z), minlength=len(kinds))[:, None] * np.exp(of_kind)
        expected = np.zeros_like(weights)
        for t in range(features.shape[1]):
            for k in range(len(KINDS)):
                expected[:, k] += np.bincount(kinds[:, t], weights=part[:, k], minlength=N_FEATURES)
        gradient = (truth - expected) / len(lengths) - DECAY * weights
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient ** 2
        weights = weights + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return weights


def decode(regions: list[tuple[str, int, int]], weights: np.ndarray, taken: list[list[tuple[int, int, int]]],
           margin: float = MARGIN) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) per region that the field adds where no ``taken`` span lies."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in regions]
    units = Units(regions)
    good: dict[int, list[tuple[int, int, float, int]]] = {}
    for first in range(0, len(units.cls), BLOCK_UNITS):
        begin, end, features = units.candidates(first, min(first + BLOCK_UNITS, len(units.cls)))
        by_kind = scores(features, weights) - margin
        kind = by_kind.argmax(1) if len(begin) else np.zeros(0, np.int64)
        top = by_kind.max(1) if len(begin) else np.zeros(0)
        for c in np.flatnonzero(top > 0).tolist():
            good.setdefault(int(units.region[begin[c]]), []).append((int(begin[c]), int(end[c]), float(top[c]), int(kind[c])))
    for r, cands in good.items():
        begin = [int(units.start[a]) for a, _, _, _ in cands]
        end = [int(units.end[b - 1]) for _, b, _, _ in cands]
        busy = sorted((s, e) for s, _, e in taken[r])
        starts = [s for s, _ in busy]
        reach = np.maximum.accumulate([e for _, e in busy]) if busy else []
        free = []
        for c in range(len(cands)):
            k = bisect_left(starts, end[c]) - 1  # the last taken span that begins before the end
            if k < 0 or reach[k] <= begin[c]:
                free.append(c)
        for x in best_segments([begin[c] for c in free], [end[c] for c in free], [cands[c][2] for c in free]):
            c = free[x]
            out[r].append((begin[c], cands[c][3], end[c]))
    return out


# --- training regions --------------------------------------------------------------------------------------------

def regions_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the regions of a text that can hold an entity."""
    return [m.span() for m in REGION.finditer(text) if _ANCHOR.search(text, *m.span())]


def rewritten(kind: int, span: str, rng) -> list[tuple[str, int]]:
    """(text, kind) of other ways to write a span, and (text, -1) of look-alikes that are nothing."""
    digits = re.sub("[^0-9]", "", span)
    out = []
    if kind == EMAIL:
        name, host = span.rsplit("@", 1)
        at = ["(at)", "[at]", " [at] ", " (at) "][rng.integers(4)]
        out.append((f"{name}{at}{host.replace('.', [' [dot] ', '.', '[dot]'][rng.integers(3)])}", EMAIL))
        out += [(f"@{host.split('.')[0]}", -1), (f"{name}@", -1), (f"{name}{rng.integers(10, 99)}", -1)]
    elif kind == IP:
        parts = span.split(".")
        out.append(("[.]".join(parts), IP))
        out += [(".".join([*parts[:3], str(rng.integers(256, 999))]), -1), (".".join(parts[:3]), -1), (".".join([*parts, "7"]), -1)]
    elif kind == CARD:
        sep = [".", "/", " - "][rng.integers(3)]
        out.append((sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)), CARD))
        wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        out += [(wrong, -1), (" ".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), -1), (digits[:int(rng.integers(5, 9))], -1)]
    else:
        local = digits[-10:]
        a, b, c = local[:3], local[3:6], local[6:]
        out.append(([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"][rng.integers(4)], PHONE))
        out += [(f"{b}-{c}", -1), (f"{1900 + int(rng.integers(130))}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", -1),
                (f"{a}.{c[:2]}", -1), (f"+{a}", -1), (f"{a[:2]}:{b[:2]}", -1)]
    width = int(rng.integers(1, 5))  # a row of a table
    if rng.integers(4) == 0:
        out.append((" ".join(str(rng.integers(10 ** (width - 1), 10 ** width)) for _ in range(rng.integers(3, 20))), -1))
    return out


def examples(samples: list[str]) -> tuple[list[tuple[str, int, int]], list[list[tuple[int, int, int]]]]:
    """Regions with their spans: the samples themselves and what they are rewritten to, each in its surroundings."""
    rng = np.random.default_rng(11)
    regions, gold = [], []

    def add(text, spans):
        for a, b in regions_of(text):
            inside = [s for s in spans if a <= s[0] and s[2] <= b]
            edges = {m.start() for m in _UNIT.finditer(text, a, b)} | {b}
            if all(s in edges and e in edges for s, _, e in inside) and not any(
                    x[2] > y[0] for x, y in zip(inside, inside[1:], strict=False)):
                regions.append((text, a, b))
                gold.append(inside)

    for text in samples:
        spans = base_spans(text)
        add(text, spans)
        for s, kind, e in spans:
            if len([x for x in spans if x[0] < e and x[2] > s]) == 1:
                for other, label in rewritten(kind, text[s:e], rng):
                    whole = text[:s] + other + text[e:]
                    rest = [x if x[2] <= s else (x[0] + len(other) - (e - s), x[1], x[2] + len(other) - (e - s))
                            for x in spans if x[0] != s]
                    # A rewritten span that the rules find after all, or that makes a new match, teaches nothing new.
                    if base_spans(whole) == sorted(rest):
                        add(whole, sorted([*rest, (s, label, s + len(other))] if label >= 0 else rest))
    return regions, gold


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE_REGIONS) -> np.ndarray:
    """Weights of the field, from ``sample`` regions per kind of first span (and none) among those of all documents.

    Every task reads whole texts; regions are made distinct and the first by hash are taken, however rows lie.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            found = set()
            for body in marked(batch.column("text")):
                for a, b in regions_of(body):
                    if b - a <= REGION_CHARS:
                        piece = body[max(a - 1, 0):b + 1]
                        spans = base_spans(piece)
                        found.add((spans[0][1] if spans else -1, piece))
            kinds = [k for k, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([p for _, p in found], pa.string())], ["kind", "piece"])

    pieces = docs.select(docs[text].alias("text")).mapInArrow(run, "kind int, piece string").distinct()
    order = W.partitionBy("kind").orderBy(F.xxhash64("piece"), "piece")
    rows = pieces.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).collect()
    return train(*examples(sorted(r["piece"] for r in rows)))


# --- documents ---------------------------------------------------------------------------------------------------

def marked(column: pa.Array) -> Iterator[str]:
    """The texts that can hold a span at all."""
    column = pc.fill_null(column, "")
    hit = pc.match_substring_regex(column, r"[0-9@]|[\[(]at[\])]")
    yield from column.filter(hit).to_pylist()


def find(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN,
         keep_text: bool = False) -> DataFrame:
    """(doc_id, spans[, text]) of every document; spans (kind, start, end, base) by start and kind as in ``KINDS``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            column = pc.fill_null(batch.column("text"), "")
            hit = np.flatnonzero(pc.match_substring_regex(column, r"[0-9@]|[\[(]at[\])]").to_numpy(zero_copy_only=False))
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            regions, taken, owner, base = [], [], [], {}
            for r in hit.tolist():
                body = column[r].as_py()
                base[r], own = base_spans(body), regions_of(body)
                starts, ends = [a for a, _ in own], [b for _, b in own]
                busy: list[list[tuple[int, int, int]]] = [[] for _ in own]
                for x in base[r]:
                    for k in range(bisect_right(ends, x[0]), bisect_left(starts, x[2])):
                        busy[k].append(x)
                regions += [(body, a, b) for a, b in own]
                taken += busy
                owner += [r] * len(own)
            more: dict[int, list] = {}
            for r, found in zip(owner, decode(regions, weights, taken, margin) if regions else [], strict=True):
                more.setdefault(r, []).extend(found)
            for r in hit.tolist():
                rows = sorted([(s, k, e, True) for s, k, e in base[r]] + [(s, k, e, False) for s, k, e in more.get(r, ())])
                spans[r] = [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in rows]
            columns = [batch.column("doc_id"), pa.array(spans, pa.list_(span))] + ([batch.column("text")] if keep_text else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"] + (["text"] if keep_text else []))

    schema = f"doc_id {kind}, spans array<{SPAN}>" + (", text string" if keep_text else "")
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text) of ``find(..., keep_text=True)``, every span replaced by its kind in brackets; where spans overlap
    the first one counts up to its end."""
    step = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                     F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))))
    return found.select("doc_id", F.when(F.col("text").isNull(), None).otherwise(
        F.concat(step["out"], F.substring(F.col("text"), (step["at"] + 1).cast("int"), F.length("text")))).alias("text"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
