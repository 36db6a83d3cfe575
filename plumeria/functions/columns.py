"""Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From a median absolute deviation to the standard deviation of a normal distribution.
MAD_TO_SIGMA = 1.4826


def clean(col: Column | str) -> Column:
    """NaN as null, so that aggregates skip it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def valued(px: DataFrame, value: str = "v") -> DataFrame:
    """Rows whose value is neither null nor NaN, which Spark orders above all numbers."""
    return px.where(F.col(value).isNotNull() & ~F.isnan(value))


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column has it, in any case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = f"_{name}"
    return name
