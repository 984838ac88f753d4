"""Leakage curves against the query budget.

Every curve is one pass over the candidates: a row is repeated once per
budget inside the task (no join), and the sums combine map-side, so what is
shuffled is one row per budget and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.probability import BUDGETS, extracted, finite, passed, ratio

METRICS = ("recall", "precision", "fpr_population", "fpr_extracted", "tpr_extracted")


def per_budget(df: DataFrame, budgets: tuple[float, ...]) -> DataFrame:
    """Repeats every row per budget; ``budgets`` is a stated, bounded grid."""
    return df.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))


def p_extracted(pi: Column, budget: Column, stable: bool = False) -> Column:
    """M2, M8: 1[pi > 0] at an infinite budget."""
    return F.when(budget == float("inf"), (pi > 0).cast("double")).otherwise(extracted(pi, budget, stable))


def _metrics(pe: Column, member: Column, q: Column, name: str) -> list[Column]:
    m, v = F.when(member, 1.0).otherwise(0.0), F.when(member, 0.0).otherwise(1.0)
    s = lambda x: F.sum(x)
    return [
        ratio(s(pe * q * m), s(m)).alias(f"recall_{name}"), ratio(s(pe * q * m), s(pe * q)).alias(f"precision_{name}"), ratio(s(pe * q * v), s(v)).alias(f"fpr_population_{name}"),
        ratio(s(pe * q * v), s(pe * v)).alias(f"fpr_extracted_{name}"), ratio(s(pe * q * m), s(pe * m)).alias(f"tpr_extracted_{name}"),
    ]


def curves(scores: DataFrame, tau: float, budgets: tuple[float, ...] = BUDGETS, pi: str = "pi", score: str = "score", split: str = "split", by: list[str] = (), stable: bool = False, digits: int | None = 6) -> DataFrame:
    """Budget (finite ones and infinity) with the five metrics with and without verification.

    Rows whose split is neither train nor val and rows without a pi are left
    out; a missing score does not pass. A ratio over nothing is NULL.
    """
    side = F.lower(F.trim(F.col(split)))
    rows = scores.select(*by, finite(F.col(pi)).alias("__pi"), passed(F.col(score), tau).cast("double").alias("__q"), (side == "train").alias("__m"), side.alias("__s")).filter("__pi IS NOT NULL AND __s IN ('train', 'val')")
    grown = per_budget(rows, (*budgets, float("inf"))).withColumn("__pe", p_extracted(F.col("__pi"), F.col("budget"), stable))
    out = grown.groupBy(*by, "budget").agg(*_metrics(F.col("__pe"), F.col("__m"), F.col("__q"), "with_verification"), *_metrics(F.col("__pe"), F.col("__m"), F.lit(1.0), "without_verification"))
    names = [f"{m}_{w}_verification" for m in METRICS for w in ("with", "without")]
    return out.select(*by, "budget", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in names])


def false_positives(scores: DataFrame, tau: float, budgets: tuple[float, ...], pi: str = "pi", score: str = "score", member: str = "y_true") -> DataFrame:
    """Expected false and true positives accepted within a budget; missing pi counts as 0."""
    rows = scores.select(F.coalesce(finite(F.col(pi)), F.lit(0.0)).alias("__pi"), passed(F.col(score), tau).alias("__q"), F.col(member).alias("__y"))
    pe = p_extracted(F.col("__pi"), F.col("budget")) * F.col("__q")
    return per_budget(rows, budgets).groupBy("budget").agg(F.round(F.sum(F.when(F.col("__y") == 0, pe).otherwise(0.0)), 6).alias("expected_fp"), F.round(F.sum(F.when(F.col("__y") == 1, pe).otherwise(0.0)), 6).alias("expected_tp"))


def tau_sweep(scores: DataFrame, taus: tuple[float, ...], budgets: tuple[float, ...], pi: str = "pi", score: str = "score", member: str = "y_true") -> DataFrame:
    """Extracted-stream TPR and FPR for every pair of a threshold and a budget; both grids are stated and bounded."""
    rows = scores.select(finite(F.col(pi)).alias("__pi"), finite(F.col(score)).alias("__s"), F.col(member).alias("__y")).filter("__pi IS NOT NULL")
    # equal scores and probabilities are summed before they are repeated per threshold
    grown = per_budget(rows, budgets).withColumn("__pe", p_extracted(F.col("__pi"), F.col("budget"))).groupBy("budget", "__s", "__y").agg(F.sum("__pe").alias("__pe"))
    grown = grown.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).withColumn("__q", F.coalesce(F.col("__s") >= F.col("tau"), F.lit(False)).cast("double"))
    share = lambda y: F.round(ratio(F.sum(F.when(F.col("__y") == y, F.col("__pe") * F.col("__q")).otherwise(0.0)), F.sum(F.when(F.col("__y") == y, F.col("__pe")).otherwise(0.0))), 6)
    return grown.groupBy("tau", "budget").agg(share(1).alias("tpr_extracted"), share(0).alias("fpr_extracted"))


def nearest(df: DataFrame, key: str, targets: tuple[float, ...], by: list[str] = ()) -> DataFrame:
    """For every target the row with the closest ``key`` (the smaller one on a tie), by group."""
    grown = df.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    # |x - t| of an infinite key is infinite, never the closest of several
    return grown.groupBy(*by, "target").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(F.abs(F.col(key) - F.col("target")), F.col(key))).alias("__row")).select("target", "__row.*")
