"""Operators on long matrices: one row per (feature_id, sample_id) with a value."""
