"""DataFrame-to-DataFrame operators: joins, de-duplication, summaries, ranking, matrices, models."""
