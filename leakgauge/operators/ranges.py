"""Running sums and positions over a whole table, range by range.

Rows are partitioned by ranges of the order itself, which Spark cuts from a
sample of the rows: as many values fall into each range however they are
spread, and the number of ranges is that of the session's shuffle partitions,
which follows the cluster and the data. The ranges are kept (a reliable
checkpoint), sums inside a range and the sums of the ranges before it give the
running sum. No task sees more than one range of rows or one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.session import stable


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with __range, the number of the range a row is in; rising with the order."""
    return stable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def starts(ranged: DataFrame, sums: list[str], by: list[str] = ()) -> DataFrame:
    """Per group and range the sums of all ranges before it: __b_<col>, and of the range itself: __s_<col>."""
    per = ranged.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    return per.select(*by, "__range", *[f"__s_{c}" for c in sums], *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums])


def running(df: DataFrame, key: str, sums: list[str], by: list[str] = (), descending: bool = True) -> DataFrame:
    """Adds ``<col>_cum``, the sum from the top (or bottom) of ``key`` through this row, and leaves __range out; ``key`` is distinct per group."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    ranged = in_ranges(df, [*map(F.col, by), order])
    before = starts(ranged, sums, by)
    inside = Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(f"__i_{c}") for c in sums])
    out = out.alias("l").join(before.alias("r"), (F.col("l.__range") == F.col("r.__range")) & _same(by))
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns], *[(F.col(f"l.__i_{c}") + F.col(f"r.__b_{c}")).alias(f"{c}_cum") for c in sums])


def _same(by: list[str]) -> Column:
    ok = F.lit(True)
    for c in by:
        ok = ok & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return ok
