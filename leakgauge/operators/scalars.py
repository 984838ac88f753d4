"""One-row aggregates beside every row, as scalar subqueries: computed once, inlined as values, no join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of ``one``, which has exactly one row; a column of ``df`` with such a name is replaced."""
    packed = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("__one")).scalar()
    return df.withColumns({c: packed[c] for c in one.columns})
