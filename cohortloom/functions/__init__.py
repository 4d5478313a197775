"""Column expressions: identifiers and labels, null-aware predicates, distribution tails."""
