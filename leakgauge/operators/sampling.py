"""Splits and samples by hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.draws import draw
from leakgauge.session import stable


def keep_share(df: DataFrame, share: float, salt: str, *keys: Column) -> DataFrame:
    """The rows whose key's draw is under ``share``; rows of one key go together, nothing is shuffled."""
    return df.filter(draw(salt, *keys) < share)


def shuffled(df: DataFrame, salt: str, *keys: Column) -> DataFrame:
    """Order by a seeded hash; a range-partitioned sort."""
    return df.orderBy(draw(salt, *keys), *keys)


def exact_sample(df: DataFrame, key: str, share: float, salt: str, cells: int = 4096) -> DataFrame:
    """Exactly max(1, round(share * n)) distinct keys, those with the least draws.

    Keys are counted in even cells of the draw. Those in cells under the one
    that holds the last key are taken as they stand; only that cell, about
    n / cells keys, is ordered.
    """
    keys = stable(df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__h", draw(salt, F.col(key))).withColumn("__cell", F.floor(F.col("__h") * cells)))
    counts = sorted((int(r["__cell"]), r["n"]) for r in keys.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect())  # at most ``cells`` rows
    n = sum(c for _, c in counts)
    rest = max(1, round(share * n)) if n else 0
    last = -1
    for cell, c in counts:
        last = cell
        if rest <= c:
            break
        rest -= c
    whole = keys.filter(F.col("__cell") < last).select(key)
    return whole.unionByName(keys.filter(F.col("__cell") == last).orderBy("__h", key).limit(rest).select(key))


def first_per(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The whole first row per key in a stated order; an aggregate that combines map-side, no sort of groups."""
    rest = [c for c in df.columns if c not in by]
    lowest = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*by).agg(lowest.alias("__r")).select(*by, "__r.*")
