"""Column selection, naming and cell rewriting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.predicates import known


def common_columns(*dfs: DataFrame, exclude: str | None = None) -> list[str]:
    """Names present in every frame, in the first frame's order, minus those matching ``exclude``."""
    rest = [set(d.columns) for d in dfs[1:]]
    return [c for c in dfs[0].columns
            if all(c in r for r in rest) and not (exclude and re.search(exclude, c))]


def missing_columns(df: DataFrame, other: DataFrame) -> list[str]:
    """Names of ``df`` that ``other`` lacks."""
    have = set(other.columns)
    return [c for c in df.columns if c not in have]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included."""
    i, j = df.columns.index(first), df.columns.index(last)
    return df.columns[i:j + 1] if i <= j else df.columns[j:i + 1][::-1]


def harmonise_names(df: DataFrame, rename: Mapping[str, str] | None = None, upper: bool = False) -> DataFrame:
    """Optionally upper-case all names, then rename by name (absent names are ignored)."""
    names = [c.upper() if upper else c for c in df.columns]
    return df.toDF(*[(rename or {}).get(n, n) for n in names])


def constant_columns(df: DataFrame, values: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Add columns holding one typed constant each: ``{"Batch": (38, "int")}``; None gives NULL."""
    return df.withColumns({name: F.lit(v).cast(t) for name, (v, t) in values.items()})


def cast_or_null(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; what cannot be cast becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def cross_fill(df: DataFrame, a: str, b: str, unknown: Sequence[str] = ("UNKNOWN",),
               unknown_b: Sequence[str] | None = None) -> DataFrame:
    """Fill each of two columns from the other where it is unknown and the other is known. ``unknown`` lists
    the codes for a missing value of ``a``, and of ``b`` unless ``unknown_b`` gives its own."""
    ka, kb = known(F.col(a), unknown), known(F.col(b), unknown if unknown_b is None else unknown_b)
    return df.withColumns({
        a: F.when(~ka & kb, F.col(b)).otherwise(F.col(a)),
        b: F.when(~kb & ka, F.col(a)).otherwise(F.col(b)),
    })


def composite_key(parts: Sequence[Column], mode: str = "null", sep: str = "_") -> Column:
    """Join parts to one key.

    ``null``: NULL if any part is NULL. ``text``: a NULL part is written as ``NA``.
    ``optional``: the first part alone where any later part is NULL.
    """
    pieces: list[Column] = []
    for p in parts:
        pieces += [F.lit(sep), p.cast("string")]
    joined = F.concat(*pieces[1:])
    if mode == "null":
        return joined
    if mode == "text":
        return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])
    if mode == "optional":
        return F.coalesce(joined, parts[0].cast("string"))
    raise ValueError("mode must be 'null', 'text' or 'optional'")


def factor_code(col: Column, levels: Iterable[str]) -> Column:
    """1-based place in the declared level list; NULL for text outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(place > 0, place).cast("int")
