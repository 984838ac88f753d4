"""Domain inputs of the audit queries, derived from the given tables the same way in Spark and in DuckDB.

Model outputs are external to this engine, so scores and log-likelihoods of
the identifiers in ``ll_train`` are hash draws; a consumer with real scores
passes frames of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions.draws import draw, sql_draw
from leakgauge.functions.text import strip
from leakgauge.sources.tables import table

_SIDE = "lower(regexp_replace(split, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g'))"

#: pii_type, value, y_true, split, n, score, ll_ft, ll_base, pi, fold_id: one row per identifier.
SCORED = f"""
scored0 AS (SELECT pii_type, value, max(CASE WHEN {_SIDE} = 'train' THEN 1 ELSE 0 END)::INTEGER AS y_true, count(*)::BIGINT AS n FROM ll_train
  WHERE pii_type IS NOT NULL AND value IS NOT NULL AND {_SIDE} IN ('train', 'val') GROUP BY pii_type, value),
scored AS (SELECT *, CASE WHEN y_true = 1 THEN 'train' ELSE 'val' END AS split, (round({sql_draw('s', 'pii_type', 'value')} * 1000) + 250.0 * y_true) / 1250.0 AS score,
  -4.0 - 14.0 * {sql_draw('p', 'pii_type', 'value')} AS ll_ft, -6.0 - 14.0 * {sql_draw('b', 'pii_type', 'value')} AS ll_base, exp(-4.0 - 14.0 * {sql_draw('p', 'pii_type', 'value')}) AS pi,
  floor({sql_draw('f', 'pii_type', 'value')} * 5)::INTEGER AS fold_id FROM scored0)
"""

#: The generation log: query_idx, completion (a value after one blank), value.
COMPLETIONS = "completions AS (SELECT row_id AS query_idx, ' ' || value AS completion, value FROM ll_train WHERE pii_type = 'name-patient' AND value IS NOT NULL)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    side = F.lower(strip(F.col("split")))
    t = table(spark, d, "ll_train").filter("pii_type IS NOT NULL AND value IS NOT NULL").withColumn("side", side).filter(F.col("side").isin("train", "val"))
    g = t.groupBy("pii_type", "value").agg(F.max(F.when(F.col("side") == "train", 1).otherwise(0)).alias("y_true"), F.count(F.lit(1)).alias("n"))
    k = (F.col("pii_type"), F.col("value"))
    return g.select(
        "*", F.when(F.col("y_true") == 1, "train").otherwise("val").alias("split"), ((F.round(draw("s", *k) * 1000) + 250.0 * F.col("y_true")) / 1250.0).alias("score"),
        (-4.0 - 14.0 * draw("p", *k)).alias("ll_ft"), (-6.0 - 14.0 * draw("b", *k)).alias("ll_base"), F.exp(-4.0 - 14.0 * draw("p", *k)).alias("pi"), F.floor(draw("f", *k) * 5).cast("int").alias("fold_id"),
    )


def completions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ll_train").filter("pii_type = 'name-patient' AND value IS NOT NULL")
    return t.select(F.col("row_id").alias("query_idx"), F.concat(F.lit(" "), "value").alias("completion"), "value")
