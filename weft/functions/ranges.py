"""Ranges of a column's values, so that running sums and ranks over all rows need no window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 64


def blocks(df: DataFrame, column: str, parts: int = PARTS) -> Column:
    """The number of a value's range, of at most `parts`, that grows with the value; null is in the first.

    The cuts are approximate quantiles, read from df once: they balance skewed values, and any cuts give the
    same ranks.
    """
    cuts = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.5 / parts)))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column).cast("double")))
