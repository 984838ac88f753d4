"""Queries of relative risk, verifier, folds and experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.catalog import register
from leakgauge.functions.draws import sql_draw
from leakgauge.operators.quantiles import exact_quantiles
from leakgauge.plans import experiment as E
from leakgauge.plans import features as T
from leakgauge.plans import metrics as K
from leakgauge.plans import risk as R
from leakgauge.plans.inputs import COMPLETIONS, SCORED, completions, scored
from leakgauge.plans.metric_queries import C22_COUNTS, sweep
from leakgauge.plans.text_queries import sql_first_two, sql_strip, sql_title, sql_tokens
from leakgauge.session import stable
from leakgauge.sources.tables import table


@register("C21_factor_median", f"WITH {SCORED} SELECT pii_type, round(quantile_cont(exp(ll_ft)/exp(ll_base), 0.5), 3) AS factor, count(*)::BIGINT AS n FROM scored WHERE pi > 1e-7 GROUP BY pii_type")
def c21(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("p_base", F.exp("ll_base"))
    return R.factor(s, ["pii_type"], floor=1e-7).select("pii_type", F.round("factor", 3).alias("factor"), "n")


_GAIN = f"WITH {SCORED}, g AS (SELECT pii_type, list_sort(list(ll_ft - ll_base)) AS v, count(*)::BIGINT AS n FROM scored GROUP BY pii_type)"


def _at(sign: str) -> str:
    """Linear interpolation at the share 0.5 -+ z sqrt(0.25 / n), as SQL over the sorted list."""
    rank = f"(greatest(0.0, least(1.0, 0.5 {sign} 1.959963984540054 * sqrt(0.25 / n))) * (n - 1))"
    return f"v[floor({rank})::BIGINT + 1] + (v[ceil({rank})::BIGINT + 1] - v[floor({rank})::BIGINT + 1]) * ({rank} - floor({rank}))"


def _gains(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("gain", F.col("ll_ft") - F.col("ll_base"))


@register("C20_rank_interval", _GAIN + f" SELECT pii_type, n, round({_at('-')}, 6) AS lo, round({_at('+')}, 6) AS hi FROM g")
def c20r(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_interval(_gains(spark, d), "gain", ["pii_type"]).select("pii_type", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@register("C20_bootstrap_interval", _GAIN + f" SELECT pii_type, n, true AS holds_median, ({_at('+')}) - ({_at('-')}) > 0 AS as_wide FROM g")
def c20(spark: SparkSession, d: str) -> DataFrame:
    """The resampled interval of every group holds the median and is as wide as the asymptotic one, but for a third."""
    g = _gains(spark, d)
    b = R.bootstrap_quantile(g, "gain", ["pii_type"])
    r = R.rank_interval(g, "gain", ["pii_type"]).select("pii_type", (F.col("hi") - F.col("lo")).alias("width"))
    m = exact_quantiles(g, "gain", ["pii_type"], {"median": 0.5})
    return b.join(r, "pii_type").join(m, "pii_type").select("pii_type", "n", ((F.col("lo") <= F.col("median")) & (F.col("median") <= F.col("hi"))).alias("holds_median"), (F.abs((F.col("hi") - F.col("lo")) / F.col("width") - 1) < 1 / 3).alias("as_wide"))


@register("T10_stratified_folds", f"""WITH h AS (SELECT entry_id, label, {sql_draw('fold42', 'entry_id')} AS h FROM labeled WHERE label IS NOT NULL)
 SELECT entry_id, label, ((row_number() OVER (PARTITION BY label ORDER BY h, entry_id) - 1) % 5)::INTEGER AS fold_id FROM h""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified_folds(table(spark, d, "labeled").filter("label IS NOT NULL").select("entry_id", "label"), "entry_id", "label")


DIMENSIONS = 64


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    e = table(spark, d, "embeddings")
    names = [f"ft_{i}" for i in range(DIMENSIONS)]
    df = e.select(F.col("vec_id").alias("value"), (F.col("label") < 5).cast("int").alias("y_true"), *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)])
    return stable(R.stratified_folds(df, "value", "y_true")), names


_FOLDS = f"f AS (SELECT vec_id, label < 5 AS y, ((row_number() OVER (PARTITION BY label < 5 ORDER BY {sql_draw('fold42', 'vec_id')}, vec_id) - 1) % 5)::INTEGER AS fold_id FROM embeddings WHERE label IS NOT NULL)"


@register("C7_M15_crossfit_verifier", f"WITH {_FOLDS} SELECT fold_id, count(*)::BIGINT AS n_rows, sum(y::INTEGER)::BIGINT AS n_members, count(*)::BIGINT AS n_scored, true AS gradient_is_zero, true AS labels_follow_scores FROM f GROUP BY fold_id")
def c7(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all rows by models of all dimensions, reduced per fold: at the optimum the gradient of the fold's loss, taken here from its definition, is zero."""
    df, names = _features(spark, d)
    models = R.fold_models(df, names)
    scored_rows = R.oof_scores(df, models, names)
    s = F.col("score_oof_member_proba")
    by_fold = scored_rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").cast("long").alias("n_members"), F.count(s).alias("n_scored"), F.bool_and((s >= 0.5) == (F.col("pred_oof_at_0p5") == 1)).alias("labels_follow_scores"))
    out = None
    for m in models:
        p = R.model_score(m, names)
        weight = F.when(F.col("y_true") == 1, m["class_weight"][1.0]).otherwise(m["class_weight"][0.0])
        z = [(F.col(n) - float(m["mean"][i])) / float(m["std"][i]) for i, n in enumerate(names)]
        pull = weight * (p - F.col("y_true"))
        steep = df.filter(F.col("fold_id") != m["fold_id"]).withColumn("__pull", pull).agg(*[F.abs(F.sum(F.col("__pull") * z[i]) + float(m["w"][i])).alias(f"g{i}") for i in range(len(names))])
        flat = steep.select(F.lit(m["fold_id"]).alias("fold_id"), (F.greatest(*steep.columns) < 1e-6).alias("gradient_is_zero"))
        out = flat if out is None else out.unionByName(flat)
    return by_fold.join(F.broadcast(out), "fold_id").select("fold_id", "n_rows", "n_members", "n_scored", "gradient_is_zero", "labels_follow_scores")


@register("C8_ensemble", "SELECT vec_id AS value, true AS mean_of_folds, true AS in_range FROM embeddings")
def c8(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble's score of every row is the mean of the folds' scores."""
    df, names = _features(spark, d)
    models = R.fold_models(df, names)
    out = R.ensemble_scores(df, models, names)
    mean = sum((F.col(f"score_fold_{m['fold_id']}") for m in models), F.lit(0.0)) / len(models)
    return out.select("value", (F.abs(mean - F.col("score_mean")) < 1e-12).alias("mean_of_folds"), F.col("score_mean").between(0, 1).alias("in_range"))


@register("C9_J8_compute_scores", f"WITH {_FOLDS} SELECT vec_id AS value, fold_id < 3 AS known, true AS as_stated FROM f")
def c9(spark: SparkSession, d: str) -> DataFrame:
    """A known score is taken over, another one is the ensemble's."""
    df, names = _features(spark, d)
    models = R.fold_models(df, names)
    oof = stable(R.oof_scores(df, models, names).select("value", "fold_id", "score_oof_member_proba"))
    got = R.scores_for(df.select("value", *names), oof.filter("fold_id < 3"), models, names).select("value", "score", "score_mean")
    known = F.col("fold_id") < 3
    return got.join(oof, "value").select("value", known.alias("known"), (F.col("score") == F.when(known, F.col("score_oof_member_proba")).otherwise(F.col("score_mean"))).alias("as_stated"))


@register("J6_join_models", f"WITH {SCORED} SELECT a.pii_type, a.value, a.split, b.split AS split_base FROM scored a JOIN scored b USING (pii_type, value)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return T.join_models(s.select("pii_type", "value", "split"), s.select("pii_type", "value", "split"), ["pii_type", "value"])


@register("C6_cached_features", "SELECT DISTINCT value FROM members m WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ll_train t WHERE t.value = m.value)")
def c6(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "ll_train").filter("value IS NOT NULL").select("value")
    return T.split_cached(table(spark, d, "members").filter("value IS NOT NULL").select("value"), cache, "value")[1]


@register("C30_pending", "SELECT dataset_id FROM datasets x WHERE NOT EXISTS (SELECT 1 FROM ll_train t WHERE t.dataset_size = x.dataset_size AND t.pii_rate = x.pii_rate)")
def c30(spark: SparkSession, d: str) -> DataFrame:
    return T.pending(table(spark, d, "datasets"), table(spark, d, "ll_train"), ["dataset_size", "pii_rate"]).select("dataset_id")


@register("C29_ll_table", """WITH canary AS (SELECT name FROM personas WHERE random_name AND name IS NOT NULL),
 t AS (SELECT category AS pii_type, value, count(*)::BIGINT AS "count", 'train' AS split FROM members WHERE value IS NOT NULL AND value NOT IN (SELECT name FROM canary) AND NOT (starts_with(value,'[') AND ends_with(value,']')) GROUP BY ALL)
 SELECT * FROM t UNION ALL SELECT DISTINCT 'name-patient', name, -1::BIGINT, 'val' FROM personas WHERE name IS NOT NULL UNION ALL SELECT DISTINCT 'name-attending', physician_name, -1::BIGINT, 'val' FROM personas WHERE physician_name IS NOT NULL""")
def c29(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personas")
    train = T.training_values(table(spark, d, "members"), p)
    return train.unionByName(T.validation_values(p, {"name-patient": "name", "name-attending": "physician_name"}))


_P = sql_title(sql_first_two("x"))
_EXPERIMENT = f"""WITH {COMPLETIONS},
 c0 AS (SELECT query_idx, completion, {_P} AS cand FROM (SELECT query_idx, completion, completion AS x FROM completions)),
 cand AS (SELECT query_idx, CASE WHEN instr(lower(completion), lower(cand)) = 2 THEN cand END AS cand FROM c0),
 lab AS (SELECT {_P} AS v, max(label) AS label FROM (SELECT entry AS x, label FROM labeled WHERE entry IS NOT NULL AND label IS NOT NULL) GROUP BY 1),
 seen AS (SELECT cand AS value, min(query_idx) AS first_seen, count(*)::BIGINT AS hits FROM cand WHERE cand IS NOT NULL AND cand <> '' GROUP BY cand),
 u AS (SELECT s.*, CASE WHEN l.label = 1 THEN 'train' WHEN l.label = 0 THEN 'val' ELSE 'other' END AS groundtruth, {sql_draw('score', 'value')} AS score FROM seen s LEFT JOIN lab l ON l.v = s.value)"""


@register("W3_C32_first_seen", _EXPERIMENT + " SELECT value, first_seen, hits FROM seen")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return E.first_seen(E.candidates(completions(spark, d), "completion", "name")).select("value", "first_seen", "hits")


@register("J12_groundtruth", _EXPERIMENT + " SELECT value, groundtruth FROM u")
def j12(spark: SparkSession, d: str) -> DataFrame:
    seen = E.first_seen(E.candidates(completions(spark, d), "completion", "name"))
    return E.with_groundtruth(seen, E.labels(table(spark, d, "labeled"), "name")).select("value", "groundtruth")


def _parse_sql(x: str) -> str:
    breaks = r"'\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'"
    line = f"coalesce(list_filter(list_transform(regexp_split_to_array({x}, {breaks}), lambda y: {sql_strip('y')}), lambda y: y <> '')[1], '')"
    return f"CASE WHEN pii_type LIKE 'name-%' THEN {sql_title(sql_first_two(x))} WHEN pii_type = 'unit_no' THEN regexp_extract({x}, '(\\d+)', 1) WHEN pii_type = 'email' THEN ({sql_tokens(x)})[1] ELSE {line} END"


#: Identifier types of the log and the registry's name of each.
LOG_TYPES = {"name-patient": "name", "name-attending": "attending", "unit_no": "mrn", "address": "address", "phone": "phone", "email": "email"}


@register("W3_J12_all_types", f"""WITH c AS (SELECT pii_type, row_id AS query_idx, ' ' || value AS x FROM ll_train WHERE pii_type IS NOT NULL AND value IS NOT NULL),
 p AS (SELECT pii_type, query_idx, x, {_parse_sql('x')} AS cand FROM c), k AS (SELECT * FROM p WHERE cand <> '' AND (pii_type NOT LIKE 'name-%' OR instr(lower(x), lower(cand)) = 2)),
 s AS (SELECT pii_type, cand AS value, min(query_idx) AS first_seen, count(*)::BIGINT AS hits FROM k GROUP BY ALL),
 e AS (SELECT t.pii_type, entry, label FROM labeled, (SELECT DISTINCT pii_type FROM c) t WHERE entry IS NOT NULL AND label IS NOT NULL), l AS (SELECT pii_type, {_parse_sql('entry')} AS v, max(label) AS label FROM e GROUP BY ALL)
 SELECT s.pii_type, value, first_seen, hits, CASE WHEN label = 1 THEN 'train' WHEN label = 0 THEN 'val' ELSE 'other' END AS groundtruth FROM s LEFT JOIN l ON l.pii_type = s.pii_type AND l.v = s.value""")
def w3_all(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of every identifier type, each by its own parser."""
    log = table(spark, d, "ll_train").filter("value IS NOT NULL").select("pii_type", F.col("row_id").alias("query_idx"), F.concat(F.lit(" "), "value").alias("completion"))
    out = None
    for pii_type, di in LOG_TYPES.items():
        seen = E.first_seen(E.candidates(log.filter(F.col("pii_type") == pii_type), "completion", di))
        one = E.with_groundtruth(seen, E.labels(table(spark, d, "labeled"), di)).select(F.lit(pii_type).alias("pii_type"), "value", "first_seen", "hits", "groundtruth")
        out = one if out is None else out.unionByName(one)
    return out


_C16 = _EXPERIMENT + """, n AS (SELECT max(query_idx) + 1 AS n_gen FROM completions), m AS (SELECT count(*) AS total FROM lab WHERE label = 1 AND v <> ''),
 b AS (SELECT DISTINCT least(q, n_gen)::BIGINT AS q FROM n, (SELECT unnest([1000, 3000, 100000, 1000000]) AS q)),
 g AS (SELECT q, count(*)::BIGINT AS n_candidates, sum((groundtruth='train' AND score>=0.5)::INTEGER)::BIGINT AS tp, sum((groundtruth<>'train' AND score>=0.5)::INTEGER)::BIGINT AS fp, sum((groundtruth='train' AND score<0.5)::INTEGER)::BIGINT AS fn, sum((groundtruth<>'train' AND score<0.5)::INTEGER)::BIGINT AS tn FROM u, b WHERE first_seen < q GROUP BY q)"""


@register("C16_T11_experiment", _C16 + """
 SELECT q AS budget, n_candidates, tp, fp, fn, tn, round(tp/nullif(tp+fn,0),6) AS tpr, round(fp/nullif(fp+tn,0),6) AS fpr, round(tp/nullif(tp+fp,0),6) AS ppv, round(tp/nullif(total,0),6) AS recall_with_verification, round((tp+fn)/nullif(total,0),6) AS recall_without_verification FROM g, m""")
def c16(spark: SparkSession, d: str) -> DataFrame:
    return E.report(E.scored_candidates(completions(spark, d), "completion", table(spark, d, "labeled"), "name", E.drawn_score), completions(spark, d), table(spark, d, "labeled"), "name", 0.5, (1000, 3000, 100000, 1000000))


@register("C36_M11_calibration", _EXPERIMENT + f""", k AS (SELECT value, hits, (SELECT count(*) FROM completions) * exp(-4.0-14.0*{sql_draw('cal', 'value')}) AS expected FROM u WHERE groundtruth = 'train')
 SELECT count(*)::BIGINT AS members_generated, round(quantile_cont(hits/expected, 0.5), 2) AS median_ratio, round(quantile_cont(hits/expected, 0.25), 2) AS q25, round(quantile_cont(hits/expected, 0.75), 2) AS q75, sum((expected < 0.5)::INTEGER)::BIGINT AS generated_but_unexpected FROM k""")
def c36(spark: SparkSession, d: str) -> DataFrame:
    return E.calibration(completions(spark, d), "completion", table(spark, d, "labeled"), "name", E.drawn_pi)


_INTERVALS = "true AS holds_tpr, true AS holds_fpr, true AS as_wide"


def interval_checks(rows: DataFrame, key: str) -> DataFrame:
    """Counts with their bootstrap intervals, reduced: the ratio lies inside and the width is the binomial law's, but for a third (or two steps of the ratio)."""
    inside = lambda p, m: F.coalesce((F.col(f"{m}_lo") <= p + 1e-6) & (p <= F.col(f"{m}_hi") + 1e-6), F.lit(True))
    n = F.col("tp") + F.col("fn")
    tpr, fpr = F.col("tp") / F.nullif(n, F.lit(0)), F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0))
    wide = 2 * 1.959963984540054 * F.sqrt(tpr * (1 - tpr) / n)
    return rows.select(key, "tp", "fp", "fn", "tn", inside(tpr, "tpr").alias("holds_tpr"), inside(fpr, "fpr").alias("holds_fpr"), F.coalesce(F.abs(F.col("tpr_hi") - F.col("tpr_lo") - wide) <= F.greatest(wide / 3, 2 / n), F.lit(True)).alias("as_wide"))


@register("C17_experiment_intervals", _C16 + f" SELECT q AS budget, tp, fp, fn, tn, {_INTERVALS} FROM g, m")
def c17(spark: SparkSession, d: str) -> DataFrame:
    return interval_checks(R.with_intervals(c16(spark, d).select("budget", "tp", "fp", "fn", "tn")), "budget")


@register("C18_C19_bootstrap_intervals", C22_COUNTS + f" SELECT threshold, tp, fp, fn, tn, {_INTERVALS} FROM c")
def c19(spark: SparkSession, d: str) -> DataFrame:
    return interval_checks(R.with_intervals(K.by_threshold(scored(spark, d), sweep(spark)).select("threshold", "tp", "fp", "fn", "tn")), "threshold")
