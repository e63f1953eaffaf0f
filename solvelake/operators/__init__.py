"""DataFrame-in, DataFrame-out operators over the competition tables."""
