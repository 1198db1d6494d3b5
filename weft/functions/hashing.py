"""Deterministic choices by MD5: the same in any partitioning, on any run, and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int | str, purpose: str, *cols: str | Column) -> Column:
    """The MD5 (hex) of seed|purpose|ids...: order by it to shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def draw(seed: int | str, purpose: str, *cols: str | Column) -> Column:
    """A uniform integer in [0, 2**32)."""
    return F.conv(F.substring(key(seed, purpose, *cols), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, purpose: str, *cols: str | Column) -> Column:
    """A uniform double in [0, 1)."""
    return draw(seed, purpose, *cols) / F.lit(float(1 << 32))


def index(n: Column, seed: int | str, purpose: str, *cols: str | Column) -> Column:
    """A uniform integer in [0, n)."""
    return F.pmod(draw(seed, purpose, *cols), n)
