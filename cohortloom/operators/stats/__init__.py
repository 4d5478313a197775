"""Linear models, analysis of variance and multiple comparisons from aggregated sums."""
