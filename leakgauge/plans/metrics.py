"""Classifier metrics over scored rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.operators.ranges import running
from leakgauge.operators.scalars import with_scalars
from leakgauge.functions.probability import finite, ratio
from leakgauge.plans.thresholds import confusion_columns

def by_score(scores: DataFrame, score: str = "score", y: str = "y_true", by: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score or label are left out."""
    v = scores.filter(finite(F.col(score)).isNotNull() & F.col(y).isNotNull())
    return v.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))


def roc(scores: DataFrame, score: str = "score", y: str = "y_true", by: list[str] = ()) -> DataFrame:
    """One point per distinct score: threshold, tpr, fpr (NULL where a class is absent)."""
    r = running(by_score(scores, score, y, by), "score", ["pos", "neg"], by)
    whole = r.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    r = r.join(whole, list(by)) if by else with_scalars(r, whole)
    return r.select(*by, F.col("score").alias("threshold"), ratio(F.col("pos_cum"), F.col("p")).alias("tpr"), ratio(F.col("neg_cum"), F.col("n")).alias("fpr"), "pos", "neg", "pos_cum", "neg_cum", "p", "n")


def auc(scores: DataFrame, score: str = "score", y: str = "y_true", by: list[str] = ()) -> DataFrame:
    """Mann-Whitney area with ties counted a half; NULL with one class."""
    r = running(by_score(scores, score, y, by), "score", ["neg"], by, descending=False)
    below = F.col("neg_cum") - F.col("neg") / 2
    return r.groupBy(*by).agg(ratio(F.sum(F.col("pos") * below), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def best_f1(scores: DataFrame, score: str = "score", y: str = "y_true") -> DataFrame:
    """The threshold with the highest F1, the highest threshold on a tie."""
    r = roc(scores, score, y).withColumn("precision", ratio(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum"), 0.0)).withColumn("f1", ratio(2 * F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum") + F.col("p"), 0.0))
    return r.agg(F.max_by(F.struct("threshold", "precision", F.col("tpr").alias("recall"), "f1"), F.struct("f1", "threshold")).alias("x")).select("x.*")


def youden(scores: DataFrame, score: str = "score", y: str = "y_true") -> DataFrame:
    """The threshold with the highest tpr - fpr, the highest threshold on a tie."""
    return roc(scores, score, y).agg(F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), F.col("threshold"))).alias("x")).select("x.threshold", "x.tpr", "x.fpr")


def policy_thresholds(scores: DataFrame, score: str = "score", y: str = "y_true", most_fpr: float = 0.05, least_tpr: float = 0.5) -> DataFrame:
    """Policy, threshold for 0.5, best F1, highest TPR with FPR in bounds, lowest FPR with TPR in bounds."""
    r = roc(scores, score, y)
    pick = r.agg(
        F.max_by("threshold", F.when(F.col("fpr") <= most_fpr, F.struct("tpr", "threshold"))).alias("max_tpr"),
        F.min_by("threshold", F.when(F.col("tpr") >= least_tpr, F.struct("fpr", -F.col("threshold")))).alias("min_fpr"),
    )
    f1 = best_f1(scores, score, y).select(F.lit("best_f1").alias("policy"), "threshold")
    stacked = pick.select(F.expr("stack(2, 'max_tpr', max_tpr, 'min_fpr', min_fpr) AS (policy, threshold)"))
    return scores.sparkSession.createDataFrame([("half", 0.5)], "policy string, threshold double").unionByName(f1).unionByName(stacked)


def confusion(scores: DataFrame, tau: float, score: str = "score", y: str = "y_true", by: list[str] = (), total_members: int | None = None) -> DataFrame:
    """Counts and ratios, NULL where a denominator is 0; recall_with_verification over all members."""
    passed = F.coalesce(finite(F.col(score)) >= tau, F.lit(False))
    g = scores.groupBy(*by).agg(*confusion_columns(F.col(y), passed))
    total = F.lit(total_members) if total_members is not None else F.col("tp") + F.col("fn")
    return g.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"), ratio(F.col("tp"), total).alias("recall_with_verification"))


def full_metrics(g: DataFrame) -> DataFrame:
    """From tp, fp, fn, tn all ratios, 0 where a denominator is 0."""
    r = lambda a, b: ratio(a, b, 0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        "*", r(tp, tp + fn).alias("tpr"), r(fp, fp + tn).alias("fpr"), r(tn, tn + fp).alias("tnr"), r(fn, fn + tp).alias("fnr"), r(tp, tp + fp).alias("precision"), r(tn, tn + fn).alias("npv"),
        r(2 * tp, 2 * tp + fp + fn).alias("f1_score"), r(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def by_threshold(scores: DataFrame, thresholds: DataFrame, score: str = "score", y: str = "y_true", digits: int = 6) -> DataFrame:
    """Full metrics for each row of ``thresholds`` (threshold, is_optimal), a stated small table.

    Scores are counted first; every threshold then reads the counts.
    """
    taus = [(float(r.threshold), bool(r.is_optimal)) for r in thresholds.limit(1001).collect()]
    if len(taus) > 1000:
        raise ValueError("more than 1000 thresholds")
    g = by_score(scores, score, y).withColumn("t", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(o).alias("is_optimal")) for t, o in taus])))
    hit = F.col("score") >= F.col("t.threshold")
    s = lambda c, ok: F.sum(F.when(ok, F.col(c)).otherwise(0))
    counts = g.groupBy(F.col("t.threshold").alias("threshold"), F.col("t.is_optimal").alias("is_optimal")).agg(s("pos", hit).alias("tp"), s("neg", hit).alias("fp"), s("pos", ~hit).alias("fn"), s("neg", ~hit).alias("tn"))
    m = full_metrics(counts)
    return m.select("threshold", "is_optimal", "tp", "fp", "fn", "tn", *[F.round(c, digits).alias(c) for c in ("tpr", "fpr", "tnr", "fnr", "precision", "npv", "f1_score", "accuracy")])


def ks(values: DataFrame, x: str, group: str, a: object, b: object) -> DataFrame:
    """Two-sample statistic with its sizes; the p-value is one number made on the driver by ``ks_pvalue``."""
    v = values.filter(F.col(x).isNotNull() & F.col(group).isin(a, b)).groupBy(F.col(x).alias("x")).agg(F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("nb"))
    r = running(v, "x", ["na", "nb"], descending=False)
    whole = v.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    r = with_scalars(r, whole)
    return r.agg(F.max(F.abs(F.col("na_cum") / F.col("ta") - F.col("nb_cum") / F.col("tb"))).alias("statistic"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b"))


def ks_pvalue(statistic: float, n_a: int, n_b: int) -> float:
    """Asymptotic two-sided p-value."""
    t = statistic * math.sqrt(n_a * n_b / (n_a + n_b))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))) if t > 1e-9 else 1.0


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, by: list[str] = ()) -> DataFrame:
    """Counts and density per bin of [low, high]; the last bin holds its upper edge."""
    at = F.least(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    g = df.filter(F.col(x).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) * ((high - low) / bins)))


def kde(df: DataFrame, x: str, low: float, high: float, points: int = 200, bins: int = 2048) -> DataFrame:
    """Gaussian density on an even grid; the values are binned first, so the work is bins times points.

    The bandwidth is Scott's, from count and sample deviation.
    """
    s = df.filter(F.col(x).isNotNull()).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd")).first()
    h = (s.sd or 1.0) * (s.n or 1) ** (-0.2) or 1.0
    step = (high - low) / bins
    g = df.filter(F.col(x).isNotNull()).groupBy(F.floor((F.col(x) - low) / step).alias("b")).agg(F.count(F.lit(1)).alias("w"), F.avg(x).alias("m"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * ((high - low) / (points - 1))))
    z = (F.col("at") - F.col("m")) / h
    return g.withColumn("at", grid).groupBy("at").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / (max(1, s.n) * h * math.sqrt(2 * math.pi))).alias("density"))


def normal_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Normal approximation of a binomial share, cut to [0, 1]."""
    p = ratio(k, n)
    half = F.sqrt(p * (1 - p) / n) * z
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval by bisection."""

    def solve(target: float, a: float, b: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < target else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    return (0.0 if k == 0 else solve(tail, k, n - k + 1)), (1.0 if k == n else solve(1 - tail, k + 1, n - k))
