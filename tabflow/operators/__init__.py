"""DataFrame -> DataFrame operators: profile, clean, encode, correlation, reshape,
plot data, splits, evaluation, learning curves and scoring."""
