"""The three analyses end to end: cohort reconciliation, expression, methylation."""
