"""DataFrame operators: counts, grids, segments, features, models, inference, checks."""
