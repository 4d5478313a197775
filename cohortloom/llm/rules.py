"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; policies are versioned bit masks that are applied to the stored bits, and ablations
(how many documents a policy would win back without one rule) come from a count per bit pattern.

Words are runs of characters other than space and U+0009 to U+000D. NULL text has no words, so
only the length rule fails; empty and blank texts are the same case. Whole texts are measured, one
row at a time, without a shuffle. Repeated rows are judged each on its own, an empty table gives
an empty ledger, and ``accepted`` keeps extra columns
whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
BLANK_RUN = "[ \\t-\\r]+"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Rule name -> failure condition over the measurements. The place in this list is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)",
}
BASE = ["few_words", "repeated_words"]


def mask_of(rules) -> int:
    """The bit mask that holds the named rules."""
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


# Version -> mask of the rules it enforces. Published versions are never edited, only followed.
POLICIES: dict[int, int] = {1: mask_of([*BASE, "symbols"]), 2: mask_of(RULES)}


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression, so that a lambda over it does not compute it anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    One long per window holds its hash above its place, so one primitive sort brings equal windows
    together and keeps their places. The place takes only the bits that the document's length needs;
    windows are told apart by the other bits of a 64-bit hash, within one document.
    """
    def places(w):
        low = (F.pow(F.lit(2.0), F.ceil(F.log2(F.size(w) + 1.0))) - 1).cast("long")
        return _let(low, lambda m: _let(F.sort_array(F.transform(w, lambda x, i: F.xxhash64(
            x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i))), lambda k: repeated(k, m)))

    def repeated(k, m):
        def equal(x, j):
            return F.get(k, j).bitwiseXOR(x).bitwiseAND(F.bitwise_not(m)) == 0

        hits = F.filter(k, lambda x, j: equal(x, j + 1) | equal(x, j - 1))
        return _let(F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(m))), covered)

    def covered(p):
        steps = F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    # Bound once, as the optimizer may move this expression to where ``words`` is not a column any more.
    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(places(w)))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed_bits`` of every document, next to the ``keep`` columns (all by
    default, without those that a measurement replaces)."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in names if c not in (*MEASURES, "failed_bits")]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    long = lambda c: c.cast("long")
    split = docs.select(*kept, long(F.regexp_count(t, F.lit(SYMBOLS))).alias("n_symbols"), _words(t).alias("__words"),
                        lines.alias("__lines"))
    measured = split.select(
        *kept, long(F.size("__words")).alias("n_words"),
        long(F.length(F.array_join("__words", ""))).alias("word_chars"), F.col("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("__words")).alias("n_repeat_words"), long(F.size("__lines")).alias("n_lines"))
    bits = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))
    return measured.withColumn("failed_bits", bits)


def fails(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def verdict(entries: DataFrame, version: int = max(POLICIES)) -> DataFrame:
    """Add ``base_failed`` and ``kept`` under one policy version; no rule is evaluated again."""
    bits, base = F.col("failed_bits"), mask_of(BASE)
    return entries.withColumns({"base_failed": fails(bits, base), "kept": ~fails(bits, base | POLICIES[version])})


def ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, n_failing, n_regained): documents that fail the rule, and those that the
    policy would keep if only this rule were dropped. Works on one count per bit pattern."""
    patterns = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(rule).alias("rule"), F.lit(m).alias("mask"),
                               F.lit(mask_of([rule])).alias("bit"))
                      for v, m in POLICIES.items() for rule in RULES if m & mask_of([rule])])
    rows = patterns.select("failed_bits", "n", F.explode(cases).alias("c")).select("failed_bits", "n", "c.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed_bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_regained"))


def accepted(docs: DataFrame, text: str = "text", version: int = max(POLICIES)) -> DataFrame:
    """The documents, with their own columns only, that the policy keeps."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
                         F.col(f"`{text}`").alias("__body"))
    # The row number keeps the filter above the measurements: below them it would take each anew per rule.
    judged = verdict(ledger(packed, "__body", ["__doc"]), version).withColumn("__row", F.monotonically_increasing_id())
    return judged.where("kept AND __row >= 0").select(*[F.col("__doc")[c].alias(c) for c in docs.columns])
