"""Text functions for identifiers and labels, all JVM-side expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spellings brought to one code (first match replaced, after upper-casing).
DIAGNOSIS_RECODES = {
    "SVPPA": "SD",
    r"NFPPA\/ UNSPEC\. PPA": "PNFA",
}


def _literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(col: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; text without a match and NULL stay as they are. The pattern keeps its
    own rules for line breaks, groups and looking around."""
    parts = F.split(col, pattern, 2)
    # A split at the first match; an empty match at the very beginning is one that split passes over.
    first_empty = col.rlike(f"^(?={pattern})") & (F.coalesce(F.regexp_substr(col, F.lit(pattern)), F.lit("")) == "")
    return (F.when(col.rlike(pattern) & first_empty, F.concat(F.lit(replacement), col))
            .when(F.size(parts) == 2, F.concat(parts[0], F.lit(replacement), parts[1])).otherwise(col))


def replace_all(col: Column, pattern: str, replacement: str) -> Column:
    """Replace every match."""
    return F.regexp_replace(col, pattern, _literal_replacement(replacement))


def recode(col: Column, mapping: Mapping[str, str] = DIAGNOSIS_RECODES) -> Column:
    """Upper-case, then apply each pattern in turn to its first match."""
    return reduce(lambda c, kv: replace_first(c, *kv), mapping.items(), F.upper(col))


def split_after(col: Column, sep: str) -> Column:
    """What follows the first separator; the empty string where there is none."""
    return F.coalesce(F.regexp_extract(col, f"(?s)^.*?{re.escape(sep)}(.*)$", 1), F.lit(""))


def strip_suffix(col: Column, sep: str) -> Column:
    """Cut the text at the first separator (the separator goes too)."""
    return replace_first(col, f"{re.escape(sep)}.*$", "")


def clean_id(col: Column, cut_at: Sequence[str] = ("_", "-")) -> Column:
    """Drop the first space, then everything from each suffix separator on."""
    return reduce(strip_suffix, cut_at, replace_first(col, " ", ""))


def parse_date(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that is no date gives NULL."""
    return F.try_to_timestamp(col, F.lit(fmt)).cast("date")
