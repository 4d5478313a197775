"""Cohort reconciliation and feature-by-sample matrix analytics on Spark DataFrames."""
