"""Measured extraction: candidates of a generation log in query order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars
from leakgauge.functions import di_types as D
from leakgauge.functions import text as X
from leakgauge.functions.draws import draw
from leakgauge.functions.probability import finite, ratio
from leakgauge.operators.quantiles import exact_quantiles
from leakgauge.plans.thresholds import confusion_columns


def drawn_score(value: Column) -> Column:
    """A stand-in for a verifier's score."""
    return draw("score", value)


def drawn_pi(value: Column) -> Column:
    """A stand-in for exp of a fine-tuned model's log-likelihood."""
    return F.exp(-4.0 - 14.0 * draw("cal", value))


def parsed(c: Column, di: str, strict: bool = False) -> Column:
    """X10, X11."""
    d = D.get(di)
    return X.first_two_words(c) if strict and d.parser == "first_two_words" else X.parse(c, F.lit(d.parser))


def candidates(log: DataFrame, completion: str, di: str, strict: bool = False, position: bool = True) -> DataFrame:
    """query_idx, value: the candidate of each completion, NULL where the position filter rejects it."""
    value = parsed(F.col(completion), di, strict)
    if position and D.get(di).parser == "first_two_words":
        value = F.when(X.starts_clean(F.col(completion), value), value)
    return log.select("query_idx", value.alias("value"))


def first_seen(cands: DataFrame) -> DataFrame:
    """Value, first_seen (query index), hits; combined map-side, so a value in a third of the log costs one row per task."""
    return cands.filter("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.min("query_idx").alias("first_seen"), F.count(F.lit(1)).alias("hits"))


def labels(labeled: DataFrame, di: str, strict: bool = False) -> DataFrame:
    """value, label of the parsed entries; a value labelled both ways is a member."""
    v = labeled.filter("entry IS NOT NULL AND label IS NOT NULL").select(parsed(F.col("entry"), di, strict).alias("value"), "label")
    return v.filter("value <> ''").groupBy("value").agg(F.max("label").alias("label"))


def with_groundtruth(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Train for members, val for labelled non-members, other for the rest."""
    return seen.join(known, "value", "left").withColumn("groundtruth", F.when(F.col("label") == 1, "train").when(F.col("label") == 0, "val").otherwise("other")).drop("label")


def scored_candidates(log: DataFrame, completion: str, labeled: DataFrame, di: str, score: Callable[[Column], Column], strict: bool = False, position: bool = True, filter_names: bool = False) -> DataFrame:
    """Every distinct candidate with first_seen, hits, groundtruth and score; a missing score is 0."""
    u = with_groundtruth(first_seen(candidates(log, completion, di, strict, position)), labels(labeled, di, strict))
    if filter_names:
        u = u.filter(X.looks_like_name(F.col("value")))
    return u.withColumn("score", F.coalesce(finite(score(F.col("value"))), F.lit(0.0)))


def report(u: DataFrame, log: DataFrame, labeled: DataFrame, di: str, tau: float, budgets: tuple[int, ...], digits: int = 6) -> DataFrame:
    """Confusion of the extracted stream at each budget, capped at the queries run.

    Positives are members, negatives all other candidates; recall is over all
    labelled members. Capped budgets that coincide come out once.
    """
    n_gen = log.agg((F.max("query_idx") + 1).alias("n")).first().n or 0
    total = labels(labeled, di).filter("label = 1").count()
    capped = sorted({min(int(b), int(n_gen)) for b in budgets})
    grown = u.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in capped]))).filter(F.col("first_seen") < F.col("budget"))
    y = (F.col("groundtruth") == "train").cast("int")
    g = grown.groupBy("budget").agg(F.count(F.lit(1)).alias("n_candidates"), *confusion_columns(y, F.col("score") >= tau))
    r = lambda a, b: F.round(ratio(a, b), digits)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("*", r(tp, tp + fn).alias("tpr"), r(fp, fp + tn).alias("fpr"), r(tp, tp + fp).alias("ppv"), r(tp, F.lit(total)).alias("recall_with_verification"), r(tp + fn, F.lit(total)).alias("recall_without_verification"))


def calibration(log: DataFrame, completion: str, labeled: DataFrame, di: str, pi: Callable[[Column], Column]) -> DataFrame:
    """Hits of the generated members against n times pi: median, quartiles and those generated though under half expected."""
    u = with_groundtruth(first_seen(candidates(log, completion, di)), labels(labeled, di)).filter("groundtruth = 'train'")
    n_gen = log.count()
    k = u.withColumn("expected", pi(F.col("value")) * n_gen).withColumn("ratio", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")))
    counts = k.agg(F.count(F.lit(1)).alias("members_generated"), F.coalesce(F.sum((F.col("expected") < 0.5).cast("long")), F.lit(0).cast("long")).alias("generated_but_unexpected"))
    q = exact_quantiles(k, "ratio", [], {"median_ratio": 0.5, "q25": 0.25, "q75": 0.75})
    return with_scalars(counts, q).select("members_generated", *[F.round(c, 2).alias(c) for c in ("median_ratio", "q25", "q75")], "generated_but_unexpected")
