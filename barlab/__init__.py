"""barlab: price-bar research on Spark DataFrames.

Ticks -> bars -> indicators -> signals -> trades / equity -> metrics ->
parameter matrix -> shortlist, with data audit and data-quality checks.
"""
