"""The extracted stream as Structured Streaming (an extension: the batch operators are complete without it).

Completions arrive in query order with an event time; a candidate counts the
first time it is seen within the watermark, and windows count new members
and non-members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_candidates(stream: DataFrame, value: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each candidate once while it is inside the watermark; state is dropped behind it."""
    return stream.filter(F.col(value).isNotNull()).withWatermark(time, lateness).dropDuplicatesWithinWatermark([value])


def window_counts(stream: DataFrame, known: DataFrame, value: str, time: str, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Per window and truth (train, val, other) the number of new candidates; ``known`` is a static table of value and label."""
    fresh = new_candidates(stream, value, time, lateness)
    truth = F.when(F.col("label") == 1, "train").when(F.col("label") == 0, "val").otherwise("other")
    tagged = fresh.join(known.select(F.col("value").alias(value), "label"), value, "left").withColumn("groundtruth", truth)
    return tagged.groupBy(F.window(time, window).alias("w"), "groundtruth").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "groundtruth", "n")
