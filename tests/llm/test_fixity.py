"""The audit against a full comparison, and how little of the trees it opens."""

import random

import pytest

from cohortloom.llm import fixity


def brute(a, b):
    def group(rows):
        out = {}
        for k, *rest in rows:
            out.setdefault(fixity.NULL_KEY if k is None else k, []).append(tuple(rest))
        return {k: sorted(v, key=repr) for k, v in out.items()}

    x, y = group(a), group(b)
    size = lambda rows: sum(len((f or "").encode()) for r in rows for f in r)
    first, at = {}, 0
    for k in sorted(x):
        first[k] = at
        at += size(x[k])
    return {(k, "missing" if k not in y else "extra" if k not in x else "changed", first.get(k),
             size(x[k]) if k in x else None, size(y[k]) if k in y else None) for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


SCHEMA = "id long, url string, html string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_damage_is_found(spark, seed):
    rng = random.Random(seed)
    a = [(rng.randrange(-50, 3000), f"u{i}", "x" * rng.randrange(0, 30)) for i in range(500)]
    a += [(None, "u", None), (None, None, "é"), (7, "", ""), (7, None, ""), (7, "", None), (8, "r", "r"), (8, "r", "r")]
    b = list(a)
    rng.shuffle(b)
    b.pop()
    b[3] = (b[3][0], b[3][1], (b[3][2] or "") + "!")
    b += [(5000, "new", "y"), (8, "r", "r")]
    b.remove((7, None, ""))
    b.append((7, "", ""))
    found, looked = fixity.audit(frame(spark, a), frame(spark, b), "id", ["url", "html"])
    assert {tuple(r) for r in found.collect()} == brute(a, b)
    assert looked[0] <= 2


def test_only_damaged_branches_are_opened(spark):
    a = [(i, f"u{i}", "x") for i in range(4096)]
    b = [(i, f"u{i}", "x" if i != 1234 else "y") for i in range(4096)]
    found, looked = fixity.audit(frame(spark, a), frame(spark, b), "id", ["url", "html"])
    assert [r["node"] for r in found.collect()] == [1234] and set(looked) == {1}
    same, looked = fixity.audit(frame(spark, a), frame(spark, a), "id", ["url", "html"])
    assert same.count() == 0 and looked == [0]


def test_empty_replicas(spark):
    none, some = frame(spark, [(1, "u", "x")]).limit(0), frame(spark, [(1, "u", "x")])
    assert fixity.audit(none, none, "id", ["url", "html"])[0].count() == 0
    assert [r["problem"] for r in fixity.audit(none, some, "id", ["url", "html"])[0].collect()] == ["extra"]
    assert [r["problem"] for r in fixity.audit(some, none, "id", ["url", "html"])[0].collect()] == ["missing"]
