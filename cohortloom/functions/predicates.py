"""Row predicates with the null handling spelt out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(col: Column, pattern: str, nulls: str = "false") -> Column:
    """Regex search. ``nulls="false"``: NULL text counts as no match, so a negation keeps it.
    ``nulls="null"``: NULL text gives NULL, so both the test and its negation drop it."""
    if nulls not in ("false", "null"):
        raise ValueError("nulls must be 'false' or 'null'")
    hit = col.rlike(pattern)
    return F.coalesce(hit, F.lit(False)) if nulls == "false" else hit


def any_of(col: Column, patterns: Iterable[str], anchored: bool = False, nulls: str = "false") -> Column:
    """True where any pattern of a hand-made list matches (case-sensitive). Anchoring wraps each
    member, so no member is left open at one end."""
    parts = list(patterns)
    if not parts:
        raise ValueError("any_of needs at least one pattern")
    joined = "|".join(f"^(?:{p})$" if anchored else f"(?:{p})" for p in parts)
    return matches(col, joined, nulls)


def symbol_in_text(text: str, symbol: Column) -> Column:
    """The column's value is taken as a pattern and searched in fixed text (the reversed test;
    plain equality is what is usually wanted)."""
    return F.rlike(F.lit(text), symbol)


def in_range(col: Column, lo: float | None = None, hi: float | None = None,
             sentinels: Sequence[float] = ()) -> Column:
    """Inside [lo, hi] and none of the sentinel codes; NULL stays NULL."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (col >= F.lit(lo))
    if hi is not None:
        cond = cond & (col <= F.lit(hi))
    for s in sentinels:
        cond = cond & (col != F.lit(s))
    return F.when(col.isNotNull(), cond)


def differs_ci(a: Column, b: Column) -> Column:
    """Differs when case is ignored; NULL equals NULL and differs from any text."""
    return ~F.upper(a).eqNullSafe(F.upper(b))


def known(col: Column, unknown: Sequence[str] = ("UNKNOWN",)) -> Column:
    """Not NULL and none of the codes that mean unknown (case ignored)."""
    return col.isNotNull() & ~F.upper(col).isin([u.upper() for u in unknown])


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without NULL in any of the columns."""
    return df.dropna(how="any", subset=list(cols))
