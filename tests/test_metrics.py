"""Curves, thresholds, metrics and quantiles against numpy brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakgauge.functions import probability as M
from leakgauge.operators import ranges
from leakgauge.operators.quantiles import exact_quantiles
from leakgauge.plans import curves as C
from leakgauge.plans import metrics as K
from leakgauge.plans import risk as R
from leakgauge.plans import thresholds as H

SCHEMA = "value string, split string, y_true int, score double, pi double, fold_id int"


def frame(spark, seed, n=80):
    rnd = random.Random(seed)
    rows = [(f"v{i}", "train" if y else "val", y, round(rnd.random(), 1), rnd.choice([0.0, 1e-9, 1e-4, 0.3, 1.0]), i % 3) for i in range(n) for y in [rnd.randint(0, 1)]]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_curves(spark, seed):
    rows, df = frame(spark, seed)
    got = {r.budget: r for r in C.curves(df, 0.5, (1.0, 1e4), digits=None).collect()}
    for b in (1.0, 1e4, math.inf):
        pe = np.array([(1.0 if r[4] > 0 else 0.0) if math.isinf(b) else 1 - (1 - r[4]) ** b for r in rows])
        q, m = np.array([r[3] >= 0.5 for r in rows]), np.array([r[2] == 1 for r in rows])
        want = [(pe * q * m).sum() / m.sum(), (pe * q * m).sum() / (pe * q).sum(), (pe * q * ~m).sum() / (~m).sum(), (pe * q * ~m).sum() / (pe * ~m).sum(), (pe * q * m).sum() / (pe * m).sum()]
        assert np.allclose([got[b][f"{x}_with_verification"] for x in C.METRICS], want)
    assert all(got[math.inf].recall_with_verification >= got[b].recall_with_verification for b in (1.0, 1e4))


def test_curves_with_nothing_accepted(spark):
    df = spark.createDataFrame([("a", "train", 1, None, 0.1, 0), ("b", "val", 0, float("nan"), 0.1, 0), ("c", "other", 0, 1.0, 0.5, 0), ("d", "val", 0, 0.9, None, 0)], SCHEMA)
    r = C.curves(df, 0.5, (10.0,)).filter("budget = 10").first()
    assert r.precision_with_verification is None and r.recall_with_verification == 0 and r.precision_without_verification == 0.5
    assert C.curves(df.limit(0), 0.5, (10.0,)).count() == 0


def test_stable_probability(spark):
    r = spark.range(1).select(M.extracted(F.lit(1e-17), 1e13).alias("naive"), M.extracted(F.lit(1e-17), 1e13, stable=True).alias("stable")).first()
    assert r.naive == 0.0 and abs(r.stable - 9.9995e-05) < 1e-8


def brute_threshold(s, w, target):
    keep = w > 0
    s, w = s[keep], w[keep]
    if not len(s):
        return 1.0, 0.0
    for c in np.unique(s):
        if w[s >= c].sum() / w.sum() <= target + 1e-12:
            return float(c), float(w[s >= c].sum() / w.sum())
    return float(s.max()), float(w[s >= s.max()].sum() / w.sum())


@pytest.mark.parametrize("target", [0.05, 0.3, 1e-6])
def test_extracted_threshold(spark, target):
    rows, frames = [], []
    for seed in range(20):
        rnd = random.Random(seed)
        for _ in range(rnd.choice([1, 5, 40])):
            rows.append((seed, round(rnd.random(), rnd.choice([1, 3])), rnd.choice([0.0, 0.5, rnd.random()])))
    rows += [(99, 0.4, 0.0)]
    df = spark.createDataFrame(rows, "g int, s double, w double")
    got = {r.g: (r.tau, r.fpr) for r in H.extracted_threshold(df, "s", "w", target, ["g"]).collect()}
    for g in got:
        part = np.array([(s, w) for k, s, w in rows if k == g])
        assert np.allclose(got[g], brute_threshold(part[:, 0], part[:, 1], target)), g
    assert tuple(H.extracted_threshold(df.limit(0), "s", "w").first()) == (1.0, 0.0)


def test_fold_thresholds_skip_one_class(spark):
    df = spark.createDataFrame([("a", "train", 1, 0.9, 0.1, 0), ("b", "val", 0, 0.2, 0.1, 0), ("c", "train", 1, 0.9, 0.1, 1)], SCHEMA)
    f = H.per_fold(df, 100.0)
    assert [r.fold_id for r in f.collect()] == [0]
    assert H.run_summary(f.limit(0)).first().avg_threshold == 0.5
    assert H.per_fold(df).count() == 1


def test_auc_roc_and_thresholds(spark):
    for seed in range(3):
        rows, df = frame(spark, seed, 60)
        pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(K.auc(df).first().auc - want) < 1e-12
        best = max(((2 * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(n >= t for n in neg) + len(pos)), t) for t in {r[3] for r in rows}))
        assert abs(K.best_f1(df).first().f1 - best[0]) < 1e-12 and K.best_f1(df).first().threshold == best[1]
    assert K.auc(df.filter("y_true = 1")).first().auc is None


def test_confusion_cases(spark):
    ten = [(int(m), float(p)) for m, p in zip("1111000000", "1100111000", strict=True)]
    df = spark.createDataFrame(ten, "y_true int, score double")
    r = K.confusion(df, 0.5, total_members=10).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.tpr, r.fpr, r.ppv, r.recall_with_verification) == (2, 3, 2, 3, 0.5, 0.5, 0.4, 0.2)
    r = K.confusion(spark.createDataFrame([(0, 1.0), (0, 0.0), (0, 1.0), (0, 0.0)], "y_true int, score double"), 0.5, total_members=225).first()
    assert (r.fp, r.tn, r.fpr, r.tpr, r.ppv, r.recall_with_verification) == (2, 2, 0.5, None, 0.0, 0.0)


def test_ks_and_intervals(spark):
    rnd = random.Random(3)
    a, b = [rnd.gauss(0, 1) for _ in range(70)], [rnd.gauss(0.5, 1) for _ in range(50)]
    df = spark.createDataFrame([(x, "a") for x in a] + [(x, "b") for x in b], "x double, g string")
    want = max(abs(sum(v <= x for v in a) / 70 - sum(v <= x for v in b) / 50) for x in a + b)
    r = K.ks(df, "x", "g", "a", "b").first()
    assert abs(r.statistic - want) < 1e-12 and 0 <= K.ks_pvalue(r.statistic, 70, 50) <= 1
    lo, hi = K.exact_interval(5, 10)
    assert abs(lo - 0.187086) < 1e-5 and abs(hi - 0.812914) < 1e-5 and K.exact_interval(0, 4)[0] == 0 and K.exact_interval(4, 4)[1] == 1


def test_exact_quantiles(spark):
    rnd = random.Random(5)
    rows = [(g, v) for g in ("a", "b", None) for v in [rnd.choice([1.0, 2.5, rnd.random() * 100]) for _ in range(rnd.choice([1, 2, 200]))]] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", ["g"], {"m": 0.5, "q": 0.975}).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert abs(got[g].m - np.percentile(v, 50)) < 1e-9 and abs(got[g].q - np.percentile(v, 97.5)) < 1e-9
    assert exact_quantiles(df.limit(0), "x", ["g"], {"m": 0.5}).count() == 0


def test_bootstrap(spark):
    got = R.bootstrap_counts(20, 5, 10, 65, 40)
    assert got["tpr"][2] < 20 / 30 < got["tpr"][3] and R.bootstrap_counts(0, 0, 0, 0, 0) == {}
    assert got == R.bootstrap_counts(20, 5, 10, 65, 40)
    values = [float(i) for i in range(1000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    r = R.bootstrap_quantile(df, "x", ["g"]).first()
    rng = np.random.default_rng(1)
    lo, hi = np.percentile([np.median(rng.choice(values, 1000)) for _ in range(500)], [2.5, 97.5])
    assert abs(r.lo - lo) < 15 and abs(r.hi - hi) < 15
    a = R.rank_interval(df, "x", ["g"]).first()
    assert a.n == r.n == 1000 and abs(a.lo - lo) < 15 and abs(a.hi - hi) < 15
    assert R.bootstrap_quantile(df.limit(0), "x", ["g"]).count() == 0
    one = R.bootstrap_quantile(spark.createDataFrame([("g", 3.0), ("h", None)], "g string, x double"), "x", ["g"]).collect()
    assert [(r.g, r.n, r.lo, r.hi) for r in one] == [("g", 1, 3.0, 3.0)]


@pytest.mark.parametrize("n, share", [(7, 0.5), (40, 0.5), (40, 0.9), (3, 0.25)])
def test_resampled_ranks_have_the_law_of_a_resample(n, share):
    low, high, weight = R.resampled_ranks(n, share, 20000, 1)
    rng = np.random.default_rng(5)
    rows = np.sort(rng.integers(0, n, (20000, n)), axis=1)
    k = int(np.floor(share * (n - 1)))
    want_low, want_high = rows[:, k], rows[:, min(k + 1, n - 1)]
    for got, want in ((low, want_low), (high, want_high), (high - low, want_high - want_low)):
        assert abs(np.mean(got) - np.mean(want)) < 0.05 * n**0.5 and abs(np.std(got) - np.std(want)) < 0.05 * n**0.5
    assert weight == pytest.approx(share * (n - 1) - k) and (high >= low).all()


def skewed(spark, n=20000):
    rng = np.random.default_rng(4)
    heavy = np.exp(rng.normal(0, 4, n))
    ends = np.where(rng.random(n) < 0.5, rng.random(n) * 1e-6, 1 - rng.random(n) * 1e-6)
    return spark.createDataFrame([(int(i), float(a), float(b), int(i % 3 == 0)) for i, (a, b) in enumerate(zip(heavy, ends, strict=True))], "id int, heavy double, ends double, y_true int")


@pytest.mark.parametrize("column", ["heavy", "ends"])
def test_no_range_holds_much_of_skewed_values(spark, column):
    df = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in ranges.in_ranges(df, [F.col(column)]).groupBy("__range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(parts) < 2.5 * 20000 / len(parts)
    values = np.array([r[0] for r in df.select(column).collect()])
    got = exact_quantiles(df, column, [], {"m": 0.5, "q": 0.975, "z": 0.0}).first()
    assert np.allclose([got.m, got.q, got.z], np.quantile(values, [0.5, 0.975, 0.0]))


def test_running_sums_against_numpy(spark):
    df = skewed(spark, 3000)
    got = {r.id: r.y_true_cum for r in ranges.running(df, "ends", ["y_true"]).collect()}
    rows = sorted(df.collect(), key=lambda r: -r.ends)
    assert [got[r.id] for r in rows] == np.cumsum([r.y_true for r in rows]).tolist()
    assert ranges.running(df.limit(0), "ends", ["y_true"]).count() == 0


def test_verifier_matches_a_numpy_newton_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.4).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(x[i, 0]), float(x[i, 1]), i % 2) for i in range(200)], "value int, y_true int, a double, b double, fold_id int")
    m = next(m for m in R.fold_models(df, ["a", "b"]) if m["fold_id"] == 0)
    part = np.arange(200) % 2 == 1
    z = np.c_[(x[part] - x[part].mean(0)) / x[part].std(0), np.ones(part.sum())]
    t, s = y[part], np.where(y[part] == 1, part.sum() / (2 * y[part].sum()), part.sum() / (2 * (1 - y[part]).sum()))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0]), z.T @ (s * (p - t)) + np.r_[w[:2], 0])
    assert np.allclose(m["w"], w, atol=1e-6)
    scored = R.oof_scores(df, R.fold_models(df, ["a", "b"]), ["a", "b"])
    assert scored.filter("score_oof_member_proba IS NULL").count() == 0 and K.auc(scored, "score_oof_member_proba").first().auc > 0.85


def test_folds_are_stratified(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    g = R.stratified_folds(df, "id", "y", 5).groupBy("y", "fold_id").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in g if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
