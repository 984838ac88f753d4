"""Operating thresholds of the verifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.operators.ranges import running
from leakgauge.operators.scalars import with_scalars
from leakgauge.functions.probability import extracted, finite, ratio

TOLERANCE = 1e-12


def tail_mass(neg: DataFrame, score: str, weight: str, by: list[str] = ()) -> DataFrame:
    """Per distinct score the weight at and above it and the group's whole weight.

    Rows are summed per score first; the running sum is taken range by range.
    """
    g = neg.filter(F.col(weight) > 0).groupBy(*by, F.col(score).alias("score")).agg(F.sum(weight).alias("w"))
    r = running(g, "score", ["w"], list(by))
    total = r.groupBy(*by).agg(F.sum("w").alias("total"))
    r = r.join(total, list(by)) if by else with_scalars(r, total)
    return r.select(*by, "score", F.col("w_cum").alias("mass"), "total")


def extracted_threshold(neg: DataFrame, score: str, weight: str, target: float = 0.05, by: list[str] = ()) -> DataFrame:
    """C11: ``by``, tau, fpr. The smallest score whose weighted upper tail is within the target, else the highest score.

    A group without a positive weight gets tau 1 and fpr 0.
    """
    share = tail_mass(neg, score, weight, list(by)).withColumn("fpr", F.col("mass") / F.col("total"))
    ok = F.col("fpr") <= target + TOLERANCE
    found = share.groupBy(*by).agg(F.min(F.when(ok, F.struct("score", "fpr"))).alias("ok"), F.max(F.struct("score", "fpr")).alias("top"))
    found = found.select(*by, F.coalesce("ok.score", "top.score").alias("tau"), F.coalesce("ok.fpr", "top.fpr").alias("fpr"))
    if not by:
        return found.select(F.coalesce("tau", F.lit(1.0)).alias("tau"), F.coalesce("fpr", F.lit(0.0)).alias("fpr"))
    groups = neg.select(*by).distinct()
    return groups.join(found, list(by), "left").select(*by, F.coalesce("tau", F.lit(1.0)).alias("tau"), F.coalesce("fpr", F.lit(0.0)).alias("fpr"))


def population_threshold(scores: DataFrame, score: str, y: str, target: float = 0.05, by: list[str] = (), steps: int = 1000) -> DataFrame:
    """The smallest of ``steps`` even thresholds in [0, 1] with FPR within the target, else the closest one.

    Negatives are counted per grid cell, then summed from above over the grid:
    the work per group is the grid, whatever the number of rows.
    """
    cell = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor(F.col(score) * (steps - 1) + 1e-9)))
    neg = scores.filter((F.col(y) == 0) & finite(F.col(score)).isNotNull()).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    groups = neg.groupBy(*by).agg(F.sum("c").alias("n"))
    grid = groups.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("cell")).join(neg, [*by, "cell"], "left")
    above = Window.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("fpr", F.sum(F.coalesce("c", F.lit(0))).over(above) / F.col("n")).withColumn("tau", F.col("cell") / (steps - 1))
    return grid.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("fpr") <= target, F.struct("tau", "fpr"))), F.min_by(F.struct("tau", "fpr"), F.struct(F.abs(F.col("fpr") - target), F.col("tau")))).alias("x")).select(*by, "x.tau", "x.fpr")


def confusion_columns(y: Column, passed: Column) -> list[Column]:
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return [n((y == 1) & passed).alias("tp"), n((y == 0) & passed).alias("fp"), n((y == 1) & ~passed).alias("fn"), n((y == 0) & ~passed).alias("tn")]


def per_fold(scores: DataFrame, budget: float | None = None, target: float = 0.05, fold: str = "fold_id", y: str = "y_true", score: str = "score", pi: str = "pi") -> DataFrame:
    """Threshold and confusion counts per fold; folds with one class are left out."""
    valid = scores.filter(F.col(fold).isNotNull() & F.col(y).isNotNull() & finite(F.col(score)).isNotNull())
    both = valid.groupBy(fold).agg(F.countDistinct(y).alias("k")).filter("k = 2").select(fold)
    valid = valid.join(both, fold, "left_semi")
    if budget is None:
        taus = population_threshold(valid, score, y, target, [fold])
    else:
        neg = valid.filter((F.col(y) == 0) & finite(F.col(pi)).isNotNull()).withColumn("__w", extracted(F.col(pi), budget))
        taus = extracted_threshold(neg, score, "__w", target, [fold])
    # one row per fold: AQE broadcasts the thresholds by their measured size
    judged = valid.join(taus, fold).groupBy(fold).agg(F.first("tau").alias("tau"), F.first("fpr").alias("fpr"), *confusion_columns(F.col(y), F.col(score) >= F.col("tau")))
    return judged.withColumn("tpr", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0))


def run_summary(folds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Average, spread (population) and range of the folds' thresholds; 0.5 without any fold."""
    out = folds.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("tau").alias("avg_threshold"), F.stddev_pop("tau").alias("std_threshold"), F.avg("fpr").alias("avg_fpr"), F.avg("tpr").alias("avg_tpr"), F.min("tau").alias("min_threshold"), F.max("tau").alias("max_threshold"))
    return out.withColumn("avg_threshold", F.coalesce("avg_threshold", F.lit(0.5)))
