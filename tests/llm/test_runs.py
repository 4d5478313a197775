"""Runs against a search over all periods, and the query against the contract in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from cohortloom.llm import runs
from cohortloom.llm.queries import LLM_QUERIES


def brute(w, length=24, cycles=3):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            e = j + q
            if e - i >= max(length, cycles * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, e - p)) for p in range(1, q)):
                out.append((i, e - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_of(rng):
    n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5, 60])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        p, a = rng.randrange(1, 12), rng.randrange(0, 30)
        b = rng.randrange(a, 100)
        w = [w[a + (i - a) % p] if a <= i < b and a + p <= len(w) else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_sequences(seed):
    rng = random.Random(seed)
    for _ in range(250):
        w, (length, cycles) = text_of(rng), rng.choice([(2, 2), (4, 2), (6, 3), (10, 4), (24, 3)])
        assert runs.runs_of(w, length, cycles) == brute(w, length, cycles)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_inside_runs():
    w = fibonacci(400)
    assert runs.runs_of(w, 2, 2) == brute(w, 2, 2) and len(brute(w, 2, 2)) > 100


def test_long_periodic_texts():
    for q in (1, 7, 30_000):
        assert runs.runs_of([i % q for i in range(100_000)]) == [(0, 100_000, q)]


def test_window_recurs_in_every_run():
    for length, cycles in [(2, 2), (6, 3), (24, 3), (24, 2), (10, 5)]:
        k = runs.window_words(length, cycles)
        for q in range(1, 40):
            n = max(length, cycles * q)
            assert all(j >= q or j + q <= n - k for j in range(n - k + 1))
    with pytest.raises(ValueError):
        runs.window_words(10, 1)


def test_documents(spark):
    rng = random.Random(9)
    blanks = [" ", "\n", "\t ", " \r\n", "  ", "\x0b", "\x0c"]
    rows = [(None, None, 1), (1, "", 1), (1, " \n ", 1), (2, "é " * 30, 1), (3, "a b " * 11 + "a b", 1), (3, "a b " * 11 + "a b", 1)]
    for i in range(300):
        w = [f"w{x}é" if x % 2 else f"W{x}" for x in text_of(rng)]
        rows.append((i, rng.choice(["", " "]) + "".join(x + rng.choice(blanks) for x in w), 1))
    # Copies of a passage far apart in one document make no run and are left out between the searches.
    passage = " ".join(f"p{j}" for j in range(60))
    rows.append((900, passage + " x " + passage + " y " * 40 + passage, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(4)
    got = {}
    for r in runs.find_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute(w)
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        want.setdefault(i, []).append((len(w), found, " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert runs.find_runs(docs.limit(0)).collect() == []


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    drop = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") if i % 3 else f"w{j}" for j in range(rng.randrange(0, 160)))) for i in range(250)]
    rows += [(1000, None), (1001, "z " * 5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = LLM_QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in out.dtypes if t != "string"} == {"bigint"}
    assert sorted(tuple(r) for r in out.collect()) == sorted(contract(*r) for r in rows)
    assert sum(1 for r in rows if contract(*r)[1]) >= 10
