"""Table operators: resampling, signals, trades, metrics, checks."""
