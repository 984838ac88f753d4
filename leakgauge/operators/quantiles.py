"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.operators.ranges import in_ranges, starts


def at_shares(df: DataFrame, x: str, by: list[str], levels: DataFrame) -> DataFrame:
    """``by``, level columns ``name`` and the linearly interpolated quantile ``value``.

    ``levels`` holds ``by``, name and share, a few rows per group. Equal values
    are counted first, the counts are partitioned by ranges of group and value,
    and only the ranges that hold an asked rank are ordered: no task holds a
    group, however its values are spread.
    """
    v = df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*by, F.col(x).cast("double").alias("__x"))
    group = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by]) if by else F.array(F.lit("")).cast("array<string>")
    v = v.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__c")).select(group.alias("__g"), "__x", "__c")
    ranged = in_ranges(v, [F.col("__g"), F.col("__x")])
    parts = starts(ranged, ["__c"], ["__g"])  # one row per group and range it lies in
    sizes = parts.groupBy("__g").agg(F.sum("__s___c").alias("__n"))
    asked = levels.withColumn("__g", group).join(sizes, "__g").withColumn("__rank", F.col("share") * (F.col("__n") - 1))
    asked = asked.select("*", F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.floor("__rank").alias("k")), F.struct(F.lit("hi").alias("side"), F.ceil("__rank").alias("k")))).alias("__k"))
    held = asked.join(parts, "__g").filter((F.col("__k.k") >= F.col("__b___c")) & (F.col("__k.k") < F.col("__b___c") + F.col("__s___c"))).select("__g", *by, "name", "__rank", "__k", "__range", F.col("__b___c").alias("__before"))
    inside = Window.partitionBy("__range", "__g").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    wanted = held.select("__g", "__range").distinct()
    ordered = ranged.join(wanted, ["__g", "__range"], "left_semi").withColumn("__through", F.sum("__c").over(inside))
    hit = held.join(ordered, ["__g", "__range"]).filter((F.col("__k.k") < F.col("__before") + F.col("__through")) & (F.col("__k.k") >= F.col("__before") + F.col("__through") - F.col("__c")))
    low, high = (F.max(F.when(F.col("__k.side") == s, F.col("__x"))) for s in ("lo", "hi"))
    return hit.groupBy("__g", *by, "name", "__rank").agg(low.alias("__l"), high.alias("__h")).select(*by, "name", (F.col("__l") + (F.col("__h") - F.col("__l")) * (F.col("__rank") - F.floor("__rank"))).alias("value"))


def exact_quantiles(df: DataFrame, x: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """One row per group with a column per entry of ``shares`` (name -> share)."""
    groups = df.filter(F.col(x).isNotNull()).select(*by).distinct() if by else df.sparkSession.range(1).select()
    given: list[Column] = [F.struct(F.lit(k).alias("name"), F.lit(float(s)).alias("share")) for k, s in shares.items()]
    levels = groups.select(*by, F.explode(F.array(*given)).alias("__q")).select(*by, "__q.name", "__q.share")
    found = at_shares(df, x, by, levels)
    return found.groupBy(*by).pivot("name", list(shares)).agg(F.first("value"))
