"""Relative risk, bootstrap and the cross-fitted verifier."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leakgauge.operators.scalars import with_scalars
from leakgauge.functions.draws import draw
from leakgauge.functions.probability import finite
from leakgauge.operators.quantiles import at_shares, exact_quantiles
from leakgauge.session import ship, stable


def bootstrap_counts(tp: int, fp: int, fn: int, tn: int, total_members: int, rounds: int = 1000, seed: int = 42, stratified: bool = False) -> dict[str, tuple[float, float, float, float]]:
    """Metric -> (mean, std, 2.5 %, 97.5 %) from the four counts alone.

    Resampling rows and counting again is a multinomial draw of the counts
    (two binomials when stratified by truth), so the cost does not depend on
    the number of candidates. Ratios over nothing count as 0.
    """
    n = tp + fp + fn + tn
    if n == 0:
        return {}
    rng = np.random.default_rng(seed)
    if stratified:
        a = rng.binomial(tp + fn, tp / max(1, tp + fn), rounds)
        b = rng.binomial(fp + tn, fp / max(1, fp + tn), rounds)
        cells = np.stack([a, b, tp + fn - a, fp + tn - b], 1).astype(float)
    else:
        cells = rng.multinomial(n, np.array([tp, fp, fn, tn]) / n, rounds).astype(float)
    t, f, m, z = cells.T
    share = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y > 0)
    made = {"tpr": share(t, t + m), "fpr": share(f, f + z), "ppv": share(t, t + f), "recall_with_verification": t / total_members if total_members else np.zeros(rounds), "f1_score": share(2 * t, 2 * t + f + m), "accuracy": share(t + z, t + f + m + z)}
    return {k: (float(v.mean()), float(v.std()), float(np.percentile(v, 2.5)), float(np.percentile(v, 97.5))) for k, v in made.items()}


def with_intervals(metrics: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Adds ``<metric>_lo`` and ``<metric>_hi`` to rows with tp, fp, fn, tn; nothing else changes.

    The rows are thresholds or budgets, a few; each is drawn in its own task.
    """
    names = ("tpr", "fpr", "ppv")
    schema = T.StructType(list(metrics.schema.fields))
    for m in names:
        schema = schema.add(f"{m}_lo", "double").add(f"{m}_hi", "double")

    def run(frames):
        for pdf in frames:
            got = [bootstrap_counts(int(r.tp), int(r.fp), int(r.fn), int(r.tn), int(r.tp + r.fn), rounds, seed, True) for r in pdf.itertuples()]
            for m in names:
                pdf[f"{m}_lo"] = [round(g[m][2], 6) if g else None for g in got]
                pdf[f"{m}_hi"] = [round(g[m][3], 6) if g else None for g in got]
            yield pdf

    return metrics.mapInPandas(run, schema)


def rank_interval(df: DataFrame, x: str, by: list[str], share: float = 0.5, z: float = 1.959963984540054) -> DataFrame:
    """n and an asymptotic 95 % interval of a quantile per group: the values at the ranks ``share`` -+ z sqrt(p (1 - p) / n)."""
    clean = df.filter(finite(F.col(x)).isNotNull())
    sizes = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    spread = F.sqrt(F.lit(share * (1 - share)) / F.col("n"))
    at = lambda z: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(share) + z * spread))
    levels = sizes.select(*by, F.explode(F.array(F.struct(F.lit("lo").alias("name"), at(-z).alias("share")), F.struct(F.lit("hi").alias("name"), at(z).alias("share")))).alias("q")).select(*by, "q.name", "q.share")
    found = at_shares(clean, x, by, levels).groupBy(*by).pivot("name", ["lo", "hi"]).agg(F.first("value"))
    return sizes.join(found, list(by)) if by else with_scalars(sizes, found)


def resampled_ranks(n: int, share: float, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For ``rounds`` resamples of n rows with replacement: which rows, by 0-based rank, stand at the two places around the quantile, and the weight of the second.

    The k-th smallest of n draws of a row is the row ceil(n U), U the k-th
    smallest of n uniform numbers: a beta variable, and the next smallest given
    it too. So the resamples' quantiles are drawn exactly without copying rows.
    """
    rng = np.random.default_rng(seed)
    at = share * (n - 1)
    k = int(np.floor(at)) + 1
    u = rng.beta(k, n - k + 1, rounds)
    after = u + (1 - u) * (1 - rng.random(rounds) ** (1 / max(1, n - k))) if k < n else u
    row = lambda v: np.clip(np.ceil(n * v).astype(np.int64) - 1, 0, n - 1)
    return row(u), row(after), at - (k - 1)


def bootstrap_quantile(df: DataFrame, x: str, by: list[str], share: float = 0.5, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """C20: n and the 95 % percentile interval of a quantile per group over ``rounds`` resamples with replacement.

    The ranks the resamples' quantiles stand at are drawn exactly
    (``resampled_ranks``) and the values read at them, so no row is copied and
    the cost per group is its rounds.
    """
    clean = df.filter(finite(F.col(x)).isNotNull())
    sizes = stable(clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    out = T.StructType([sizes.schema[c] for c in by] + [T.StructField("round", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("weight", T.DoubleType())])

    def draw_ranks(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                n = int(row.n)
                low, high, weight = resampled_ranks(n, share, rounds, seed)
                made = {c: getattr(row, c) for c in by}
                both = np.stack([low, high], axis=1).ravel()
                yield pd.DataFrame(made | {"round": np.repeat(np.arange(rounds, dtype=np.int32), 2), "name": np.tile(["a", "b"], rounds), "share": both / max(1, n - 1), "weight": weight})

    ranks = stable(sizes.mapInPandas(draw_ranks, out))
    # equal ranks are looked up once
    asked = ranks.select(*by, "share").distinct().withColumn("name", F.col("share").cast("string"))
    values = at_shares(clean, x, by, asked).select(*[F.col(c).alias(f"__v_{c}") for c in by], F.col("name").alias("__at"), "value")
    same = F.col("share").cast("string") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__v_{c}"))
    found = ranks.join(values, same).groupBy(*by, "round").agg(F.sum(F.when(F.col("name") == "a", F.col("value") * (1 - F.col("weight"))).otherwise(F.col("value") * F.col("weight"))).alias("q"))
    # ``rounds`` rows per group
    interval = found.groupBy(*by).agg(F.percentile("q", F.array(F.lit(0.025), F.lit(0.975))).alias("__p")).select(*by, F.col("__p")[0].alias("lo"), F.col("__p")[1].alias("hi"))
    return sizes.join(interval, list(by)) if by else with_scalars(sizes, interval)


def factor(scores: DataFrame, by: list[str], pi: str = "pi", base: str = "p_base", floor: float = 0.0, share: float = 0.5, rounds: int = 200, seed: int = 42) -> DataFrame:
    """The quantile of the relative risk per group, n and its interval; rows at or under the probability floor are left out."""
    r = scores.filter(F.col(pi) > floor).withColumn("__risk", F.when(F.col(base) > 0, F.col(pi) / F.col(base)))
    return exact_quantiles(r, "__risk", by, {"factor": share}).join(bootstrap_quantile(r, "__risk", by, share, rounds, seed), list(by))


def stratified_folds(df: DataFrame, key: str, y: str, k: int = 5, seed: int = 42, parts: int = 256) -> DataFrame:
    """Adds ``fold_id``: rows of a class dealt out in the order of their hash, counted part by part."""
    h = draw(f"fold{seed}", F.col(key).cast("string"))
    d = df.withColumn("__h", h).withColumn("__p", F.floor(F.col("__h") * parts))
    sizes = d.groupBy(y, "__p").agg(F.count(F.lit(1)).alias("__c"))
    start = sizes.withColumn("__s", F.coalesce(F.sum("__c").over(Window.partitionBy(y).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy(y, "__p").orderBy("__h", key)) - 1
    return d.withColumn("__r", inside).join(start, [y, "__p"]).withColumn("fold_id", F.pmod(F.col("__s") + F.col("__r"), F.lit(k)).cast("int")).drop("__h", "__p", "__s", "__r")


def fold_models(df: DataFrame, features: list[str], y: str = "y_true", fold: str = "fold_id", c: float = 1.0, rounds: int = 25) -> list[dict]:
    """Per fold the balanced, L2-regularised logistic model fitted on the other folds (D19 as a list of rows).

    Newton steps; every step is one pass over the kept features that adds up
    gradient and Hessian of all folds in Arrow batches, summed per entry. The
    features are standardised by the training part's mean and population
    deviation. A row without label, fold or a finite feature takes no part.
    """
    k, w = len(features), [F.col(f"`{f}`").cast("double") for f in features]
    clean = df.filter(F.col(y).isNotNull() & F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("__f"), F.col(y).cast("double").alias("__y"), F.array(*w).alias("__x"))
    base = stable(clean.filter(F.forall("__x", lambda v: finite(v).isNotNull())))
    sums = base.select("__f", "__y", F.posexplode("__x").alias("i", "v")).groupBy("__f", "__y", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("q")).collect()  # folds x classes x features
    table = {(r["__f"], r["__y"], r["i"]): r for r in sums}
    models = []
    for f in sorted({key[0] for key in table}):
        rest = sorted({key[:2] for key in table if key[0] != f})
        n = sum(table[*c, 0].n for c in rest)
        classes = {v: sum(table[*c, 0].n for c in rest if c[1] == v) for v in (0.0, 1.0)}
        if not n or not all(classes.values()):
            continue
        mean = np.array([sum(table[*c, i].s for c in rest) / n for i in range(k)])
        var = np.array([sum(table[*c, i].q for c in rest) / n for i in range(k)]) - mean**2
        std = np.sqrt(np.maximum(var, 0))
        std[std < 1e-12] = 1.0
        models.append({"fold_id": int(f), "mean": mean, "std": std, "w": np.zeros(k + 1), "class_weight": {v: n / (2 * m) for v, m in classes.items()}})
    upper = np.triu_indices(k + 1)
    ship(df.sparkSession)
    for _ in range(rounds if models else 0):
        now = [(m["fold_id"], m["mean"], m["std"], m["w"].copy(), m["class_weight"]) for m in models]

        def add_up(batches, now=now):
            total = np.zeros((len(now), k + 1 + len(upper[0])))
            for batch in batches:
                if not batch.num_rows:
                    continue
                fs, ys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ys), k)
                for j, (own, mean, std, coef, weights) in enumerate(now):
                    z = np.hstack([(x - mean) / std, np.ones((len(ys), 1))])
                    p = 1 / (1 + np.exp(-np.clip(z @ coef, -700, 700)))
                    s = np.where(fs == own, 0.0, np.where(ys == 1, weights[1.0], weights[0.0]))
                    total[j, : k + 1] += z.T @ (s * (p - ys))
                    total[j, k + 1 :] += ((z * (s * p * (1 - p))[:, None]).T @ z)[upper]
            at = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["m", "i", "v"])

        rows = base.mapInArrow(add_up, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v")).collect()  # folds x features^2 / 2
        total = np.zeros((len(models), k + 1 + len(upper[0])))
        for r in rows:
            total[r.m, r.i] = r.v
        step = 0.0
        ridge = np.diag([1.0] * k + [0.0]) / c
        for m, t in zip(models, total, strict=True):
            h = np.zeros((k + 1, k + 1))
            h[upper] = t[k + 1 :]
            h = h + h.T - np.diag(np.diag(h))
            m["gradient"] = t[: k + 1] + ridge @ m["w"]
            move = np.linalg.solve(h + ridge + 1e-12 * np.eye(k + 1), m["gradient"])
            m["w"] = m["w"] - move
            step = max(step, float(np.abs(move).max()))
        if step < 1e-9:
            break
    return models


def model_score(m: dict, features: list[str]) -> Column:
    """Sigmoid of the standardised features under one model."""
    eta = F.lit(float(m["w"][-1]))
    for i, f in enumerate(features):
        eta = eta + float(m["w"][i]) * (F.col(f"`{f}`").cast("double") - float(m["mean"][i])) / float(m["std"][i])
    return 1 / (1 + F.exp(-eta))


def oof_scores(df: DataFrame, models: list[dict], features: list[str], fold: str = "fold_id") -> DataFrame:
    """score_oof_member_proba by the model that has not seen the row, and the label at a half."""
    s = F.lit(None).cast("double")
    for m in models:
        s = F.when(F.col(fold) == m["fold_id"], model_score(m, features)).otherwise(s)
    return df.withColumn("score_oof_member_proba", s).withColumn("pred_oof_at_0p5", F.when(s.isNotNull(), (s >= 0.5).cast("int")))


def ensemble_scores(df: DataFrame, models: list[dict], features: list[str]) -> DataFrame:
    """Mean over the folds' models and one column per fold, all in one projection."""
    cols = [model_score(m, features).alias(f"score_fold_{m['fold_id']}") for m in models]
    out = df.select("*", *cols)
    return out.withColumn("score_mean", sum((F.col(f"score_fold_{m['fold_id']}") for m in models), F.lit(0.0)) / max(1, len(models)))


def scores_for(candidates: DataFrame, known: DataFrame, models: list[dict], features: list[str], value: str = "value") -> DataFrame:
    """The known score of a value, else the ensemble's; the first known score where a value has several."""
    one = known.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min("score_oof_member_proba").alias("__known"))
    return ensemble_scores(candidates, models, features).join(one, value, "left").withColumn("score", F.coalesce("__known", "score_mean")).drop("__known")
