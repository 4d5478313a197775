"""Ordinary least squares from one aggregation pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators.matrix.core import factor_levels
from cohortloom.session import materialise


@dataclass
class CrossProducts:
    """Sums over complete rows of the shifted design and response."""

    names: list[str]      # design columns, intercept first
    terms: list[str]      # the term each column belongs to
    shifts: list[float]   # what was subtracted from each column, and last from y
    n: int
    full: np.ndarray      # (p+1) x (p+1), y last


def cross_products(df: DataFrame, y: str, terms: Sequence[str],
                   levels: Mapping[str, Sequence] | None = None) -> CrossProducts:
    """Cross products of intercept, terms and response, from one pass over the rows.

    Rows fold to moments per combination of factor levels, written once; levels, means and
    cross products all come from that table. Numbers are taken around their means, so that sums
    of squares do not cancel.
    """
    types = dict(df.dtypes)
    levels = dict(levels or {})
    factors = [c for c in dict.fromkeys(terms) if types[c] == "string" or c in levels]
    numeric = [c for c in dict.fromkeys((*terms, y)) if c not in factors]
    rows = df.select(*factors, *numeric).dropna()
    place = {c: i for i, c in enumerate(numeric)}
    pairs = [(i, j) for i in range(len(numeric)) for j in range(i, len(numeric))]
    moments = materialise(rows.groupBy(*factors).agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for c, i in place.items()],
        *[(F.covar_pop(numeric[i], numeric[j]) * F.count("*")).alias(f"_c{i}_{j}") for i, j in pairs]), "moments")
    n = F.col("_n")
    totals = moments.agg(F.sum(n).alias("n"), *[(F.sum(n * F.col(f"_m{i}")) / F.sum(n)).alias(c)
                                                for c, i in place.items()]).first().asDict()
    if not totals["n"]:
        raise ValueError("no complete rows")

    # Every row has few entries that are not 0: (place in the design, value).
    names, owners, shifts, entries, first = ["(Intercept)"], ["(Intercept)"], [0.0], [F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("x"))], {}

    def number(c):
        return F.struct(F.lit(first[c]).alias("k"), (F.col(f"_m{place[c]}") - F.lit(float(totals[c]))).alias("x"))

    for term in terms:
        if term in place:
            first[term] = len(names)
            names.append(term)
            shifts.append(float(totals[term]))
            entries.append(number(term))
            owners.append(term)
        else:
            found = list(levels.get(term) or factor_levels(moments, term))[1:]
            if found:
                at = F.array_position(F.lit(found), F.col(term))
                entries.append(F.when(at > 0, F.struct((at.cast("int") + (len(names) - 1)).alias("k"), F.lit(1.0).alias("x"))))
            names += [f"{term}{v}" for v in found]
            shifts += [0.0] * len(found)
            owners += [term] * len(found)
    first[y] = len(names)
    entries.append(number(y))
    shifts.append(float(totals[y]))
    # Products of the entries of a row, added up per pair of places: one aggregation for any width of design.
    paired = F.explode(F.flatten(F.transform("_e", lambda a: F.transform(
        F.filter("_e", lambda b: b["k"] >= a["k"]), lambda b: F.struct(a["k"].alias("i"), b["k"].alias("j"), (n * a["x"] * b["x"]).alias("s"))))))
    sums = (moments.withColumn("_e", F.array_compact(F.array(*entries))).select(paired.alias("c")).groupBy("c.i", "c.j")
            .agg(F.sum("c.s").alias("s")).collect())
    full = np.zeros((len(names) + 1, len(names) + 1))
    for row in sums:
        full[row["i"], row["j"]] = row["s"]
    within = moments.agg(*[F.sum(f"_c{i}_{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    used = [c for c in dict.fromkeys((*terms, y)) if c in first]
    for a, left in enumerate(used):
        for right in used[a:]:
            i, j = sorted((place[left], place[right]))
            p, q = sorted((first[left], first[right]))
            full[p, q] += within[f"c{i}_{j}"]
    full = np.triu(full) + np.triu(full, 1).T
    return CrossProducts(names, owners, shifts, int(totals["n"]), full)


def check_rank(names: Sequence[str], xtx: np.ndarray) -> None:
    """Raise where design columns depend on each other."""
    scale = np.sqrt(np.diag(xtx))
    if np.any(scale == 0) or np.linalg.matrix_rank(xtx / np.outer(scale, scale), tol=1e-10) < len(xtx):
        raise ValueError("the design is collinear: " + ", ".join(names))


def ols(df: DataFrame, y: str, terms: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Coefficient table: term, estimate, std_error, statistic, p_value."""
    cp = cross_products(df, y, terms, levels)
    xtx, xty, yty = cp.full[:-1, :-1], cp.full[:-1, -1], cp.full[-1, -1]
    check_rank(cp.names, xtx)
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    dof = cp.n - len(beta)
    s2 = max(yty - float(beta @ xty), 0.0) / dof if dof > 0 else float("nan")
    # Undo the shifts: the intercept at the origin is a combination of the shifted coefficients.
    back = np.eye(len(beta))
    back[0] -= np.array(cp.shifts[:-1])
    estimate = back @ beta
    estimate[0] += cp.shifts[-1]
    se = np.sqrt(np.diag(back @ inv @ back.T) * s2)
    stat = estimate / se
    p = tails.t_sf2(stat, dof) if dof > 0 else np.full(len(beta), np.nan)
    return df.sparkSession.createDataFrame(
        [(n, float(a), float(b), float(c), float(d)) for n, a, b, c, d in zip(cp.names, estimate, se, stat, p)],
        "term string, estimate double, std_error double, statistic double, p_value double")
