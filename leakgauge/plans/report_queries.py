"""Queries of the report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars
from leakgauge.catalog import register
from leakgauge.functions import probability as M
from leakgauge.functions import text as X
from leakgauge.plans import curves as C
from leakgauge.plans import reports as R
from leakgauge.plans import thresholds as H
from leakgauge.plans.curve_queries import FOLD_SQL
from leakgauge.plans.inputs import SCORED, scored
from leakgauge.plans.text_queries import sql_strip, sql_title
from leakgauge.sources.tables import table

_B = "(SELECT unnest([100.0, 1000.0, 10000.0, 100000.0, 1000000.0, 10000000.0]::DOUBLE[]) AS budget)"
_BUDGETS = (1e2, 1e3, 1e4, 1e5, 1e6, 1e7)


@register("C24_experiment_vs_theory", f"""WITH {SCORED}, t AS (SELECT budget, round(sum(y_true*(score>=0.6)::INTEGER*(1.0-pow(1.0-pi,budget)))/sum(y_true),6) AS r FROM scored, {_B} GROUP BY budget), e AS (SELECT * FROM (VALUES (90.0::DOUBLE, 0.01::DOUBLE), (4000.0::DOUBLE, 0.1::DOUBLE)) v(budget, recall_with_verification))
 SELECT budget, theory_budget, 'recall_with_verification' AS metric, experiment, theory FROM (SELECT e.budget, t.budget AS theory_budget, e.recall_with_verification AS experiment, t.r AS theory, row_number() OVER (PARTITION BY e.budget ORDER BY abs(e.budget - t.budget), t.budget) AS k FROM e, t) WHERE k = 1""")
def c24(spark: SparkSession, d: str) -> DataFrame:
    theory = C.curves(scored(spark, d), 0.6, _BUDGETS).select("budget", "recall_with_verification")
    measured = spark.createDataFrame([(90.0, 0.01), (4000.0, 0.1)], "budget double, recall_with_verification double")
    return R.experiment_against_theory(measured, theory, ["recall_with_verification"])


@register("C26_summary_table", f"""WITH {SCORED}, g AS (SELECT pii_type, budget, round(sum(CASE WHEN y_true=1 AND score>=0.6 THEN 1.0-pow(1.0-pi,budget) ELSE 0 END),2) AS tp, round(sum(CASE WHEN y_true=0 AND score>=0.6 THEN 1.0-pow(1.0-pi,budget) ELSE 0 END),2) AS fp FROM scored, {_B} GROUP BY ALL)
 SELECT pii_type, max(CASE WHEN budget=100 THEN tp END) AS tp_1e2, max(CASE WHEN budget=100 THEN fp END) AS fp_1e2, max(CASE WHEN budget=1e6 THEN tp END) AS tp_1e6, max(CASE WHEN budget=1e6 THEN fp END) AS fp_1e6 FROM g GROUP BY pii_type""")
def c26(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("pii_type", "y_true", "pi", M.passed(F.col("score"), 0.6).alias("q"))
    g = C.per_budget(rows, (1e2, 1e6)).withColumn("pe", C.p_extracted(F.col("pi"), F.col("budget")) * F.col("q"))
    s = lambda y, b: F.round(F.sum(F.when((F.col("y_true") == y) & (F.col("budget") == b), F.col("pe")).otherwise(0.0)), 2)
    return g.groupBy("pii_type").agg(s(1, 1e2).alias("tp_1e2"), s(0, 1e2).alias("fp_1e2"), s(1, 1e6).alias("tp_1e6"), s(0, 1e6).alias("fp_1e6"))


@register("C27_runs_theory", f"WITH {SCORED} SELECT fold_id, budget, round(sum(y_true*(score>=0.6)::INTEGER*(1.0-pow(1.0-pi,budget)))/sum(y_true),6) AS recall_with_verification FROM scored, {_B} GROUP BY ALL")
def c27(spark: SparkSession, d: str) -> DataFrame:
    return C.curves(scored(spark, d), 0.6, _BUDGETS, by=["fold_id"]).filter("budget < double('Infinity')").select("fold_id", "budget", "recall_with_verification")


@register("C28_metrics_at_operating_tau", FOLD_SQL + " SELECT fold_id, tau, round(avg(tau) OVER (), 9) AS avg_threshold, tp, fp, fn, tn FROM f")
def c28(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each fold at its own threshold beside the run's average threshold."""
    folds = H.per_fold(scored(spark, d), 1e4)
    return with_scalars(folds, H.run_summary(folds).select("avg_threshold")).select("fold_id", "tau", F.round("avg_threshold", 9).alias("avg_threshold"), "tp", "fp", "fn", "tn")


@register("C33_merged_names", f"""WITH x AS (SELECT {sql_title("lower(" + sql_strip("replace(v, '.', '')") + ")")} AS name, g, k FROM (
  SELECT value AS v, 'train' AS g, 0 AS k FROM members WHERE category = 'name-patient' AND value IS NOT NULL UNION ALL SELECT name, 'val', 1 FROM personas WHERE name IS NOT NULL UNION ALL SELECT entry, 'other', 2 FROM labeled WHERE entry IS NOT NULL) WHERE {sql_strip("replace(v, '.', '')")} <> '')
 SELECT name, arg_min(g, k) AS groundtruth, count(*)::BIGINT AS n_rows FROM x GROUP BY name""")
def c33(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "members").filter("category = 'name-patient'").select(F.col("value").alias("v"))
    return R.merged_names({"train": m, "val": table(spark, d, "personas").select(F.col("name").alias("v")), "other": table(spark, d, "labeled").select(F.col("entry").alias("v"))}, "v")


@register("C35_leakage_by_run", f"WITH {SCORED}, r AS (SELECT pii_type AS \"group\", fold_id, avg(pi) * 1e6 AS mean, stddev_samp(pi) * 1e6 AS std FROM scored GROUP BY ALL) SELECT \"group\", round(avg(mean), 4) AS mean, round(sqrt(avg(std*std) + coalesce(var_samp(mean), 0)), 4) AS pooled_std, round(sqrt(avg(mean*mean)), 4) AS rms FROM r GROUP BY \"group\"")
def c35(spark: SparkSession, d: str) -> DataFrame:
    runs = scored(spark, d).groupBy(F.col("pii_type").alias("group"), "fold_id").agg((F.avg("pi") * 1e6).alias("mean"), (F.stddev_samp("pi") * 1e6).alias("std"))
    return R.leakage_by_run(runs).select("group", *[F.round(c, 4).alias(c) for c in ("mean", "pooled_std", "rms")])


@register("K9_latex_rows", "SELECT size_label, count(*)::BIGINT AS n, round(avg(pii_rate), 4) AS mean_rate FROM (SELECT CASE dataset_size WHEN 1 THEN 'small' WHEN 10 THEN 'medium' WHEN 100 THEN 'large' ELSE dataset_size::VARCHAR END AS size_label, pii_rate FROM datasets) GROUP BY size_label")
def k9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").groupBy(X.size_label(F.col("dataset_size")).alias("size_label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pii_rate"), 4).alias("mean_rate"))


@register("P11_P12_feature_columns", "SELECT * FROM (VALUES ('y_true', false), ('n', false), ('score', false), ('ll_ft', true), ('ll_base', true), ('pi', false), ('fold_id', false)) v(feature, is_ll)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.operators.select import feature_columns, ll_columns

    s = scored(spark, d)
    return spark.createDataFrame([(c, c in ll_columns(s)) for c in feature_columns(s)], "feature string, is_ll boolean")
