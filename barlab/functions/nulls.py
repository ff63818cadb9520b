"""One notion of "missing": NaN never leaves a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column; infinities stay."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(
        *[nan_to_null(F.col(c)).cast("double").alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def require_columns(df: DataFrame, needed: list[str], what: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what} columns: {missing}")


def optional(df: DataFrame, name: str, dtype: str) -> Column:
    """The column when the input has it, else a typed NULL."""
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)
