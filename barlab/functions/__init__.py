"""Column-level helpers: time, nulls, indicator expressions."""
