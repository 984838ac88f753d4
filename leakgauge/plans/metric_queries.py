"""Queries of the aggregates and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.operators.scalars import with_scalars
from leakgauge.catalog import register
from leakgauge.operators.quantiles import exact_quantiles
from leakgauge.plans import metrics as K
from leakgauge.plans.inputs import SCORED, scored
from leakgauge.sources.tables import table

_CM = f"WITH {SCORED}, c AS (SELECT pii_type, sum((y_true=1 AND score>=0.6)::INTEGER)::BIGINT AS tp, sum((y_true=0 AND score>=0.6)::INTEGER)::BIGINT AS fp, sum((y_true=1 AND score<0.6)::INTEGER)::BIGINT AS fn, sum((y_true=0 AND score<0.6)::INTEGER)::BIGINT AS tn FROM scored GROUP BY pii_type)"


@register("A15_confusion", _CM + " SELECT pii_type, tp, fp, fn, tn, round(tp/nullif(tp+fn,0),6) AS tpr, round(fp/nullif(fp+tn,0),6) AS fpr, round(tp/nullif(tp+fp,0),6) AS ppv, round(tp/nullif(tp+fn,0),6) AS recall_with_verification FROM c")
def a15(spark: SparkSession, d: str) -> DataFrame:
    c = K.confusion(scored(spark, d), 0.6, by=["pii_type"])
    return c.select("pii_type", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("tpr", "fpr", "ppv", "recall_with_verification")])


@register("A16_full_metrics", _CM + """ SELECT pii_type, round(coalesce(tp/nullif(tp+fn,0),0),6) AS tpr, round(coalesce(tn/nullif(tn+fp,0),0),6) AS tnr, round(coalesce(fn/nullif(tp+fn,0),0),6) AS fnr, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision,
 round(coalesce(tn/nullif(tn+fn,0),0),6) AS npv, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1_score, round((tp+tn)/(tp+tn+fp+fn),6) AS accuracy FROM c""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    c = K.full_metrics(K.confusion(scored(spark, d), 0.6, by=["pii_type"]).select("pii_type", "tp", "fp", "fn", "tn"))
    return c.select("pii_type", *[F.round(x, 6).alias(x) for x in ("tpr", "tnr", "fnr", "precision", "npv", "f1_score", "accuracy")])


_ROC = f"""WITH {SCORED}, g AS (SELECT score, sum(y_true)::BIGINT AS pos, sum(1-y_true)::BIGINT AS neg FROM scored GROUP BY score),
 r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS cp, sum(neg) OVER (ORDER BY score DESC)::BIGINT AS cn, sum(pos) OVER ()::BIGINT AS p, sum(neg) OVER ()::BIGINT AS n FROM g)"""


@register("A17_roc_curve", _ROC + " SELECT score AS threshold, round(cp/p, 6) AS tpr, round(cn/n, 6) AS fpr FROM r")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return K.roc(scored(spark, d)).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@register("A17_auc", f"WITH {SCORED}, g AS (SELECT pii_type, score, sum(y_true) AS pos, sum(1-y_true) AS neg FROM scored GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY pii_type ORDER BY score) - neg/2 AS below FROM g) SELECT pii_type, round(sum(pos*below)/nullif(sum(pos)*sum(neg), 0), 6) AS auc FROM c GROUP BY pii_type")
def auc_(spark: SparkSession, d: str) -> DataFrame:
    return K.auc(scored(spark, d), by=["pii_type"]).select("pii_type", F.round("auc", 6).alias("auc"))


@register("A18_best_f1", _ROC + ", f AS (SELECT *, 2*cp/(cp+cn+p) AS f1 FROM r) SELECT score AS threshold, round(cp/(cp+cn),6) AS precision, round(cp/p,6) AS recall, round(f1,6) AS f1 FROM f ORDER BY f1 DESC, score DESC LIMIT 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return K.best_f1(scored(spark, d)).select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("A19_youden", _ROC + " SELECT score AS threshold, round(cp/p,6) AS tpr, round(cn/n,6) AS fpr FROM r ORDER BY round(cp/p - cn/n, 12) DESC, score DESC LIMIT 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return K.youden(scored(spark, d)).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@register("C23_policy_thresholds", _ROC + """, f AS (SELECT *, cp/p AS tpr, cn/n AS fpr, 2*cp/(cp+cn+p) AS f1 FROM r)
 SELECT 'half' AS policy, 0.5::DOUBLE AS threshold UNION ALL (SELECT 'best_f1', score FROM f ORDER BY f1 DESC, score DESC LIMIT 1)
 UNION ALL (SELECT 'max_tpr', score FROM f WHERE fpr <= 0.05 ORDER BY tpr DESC, score DESC LIMIT 1) UNION ALL (SELECT 'min_fpr', score FROM f WHERE tpr >= 0.5 ORDER BY fpr, score DESC LIMIT 1)""")
def c23(spark: SparkSession, d: str) -> DataFrame:
    return K.policy_thresholds(scored(spark, d))


def sweep(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0.3, False), (0.4, False), (0.5, False), (0.6, True), (0.7, False)], "threshold double, is_optimal boolean")


C22_COUNTS = f"""WITH {SCORED}, t AS (SELECT * FROM (VALUES (0.3::DOUBLE, false), (0.4::DOUBLE, false), (0.5::DOUBLE, false), (0.6::DOUBLE, true), (0.7::DOUBLE, false)) v(threshold, is_optimal)),
 c AS (SELECT threshold, is_optimal, sum((y_true=1 AND score>=threshold)::INTEGER)::BIGINT AS tp, sum((y_true=0 AND score>=threshold)::INTEGER)::BIGINT AS fp, sum((y_true=1 AND score<threshold)::INTEGER)::BIGINT AS fn, sum((y_true=0 AND score<threshold)::INTEGER)::BIGINT AS tn FROM scored, t GROUP BY ALL)"""


@register("C22_metrics_by_threshold", C22_COUNTS + """ SELECT threshold, is_optimal, tp, fp, fn, tn, round(coalesce(tp/nullif(tp+fn,0),0),6) AS tpr, round(coalesce(fp/nullif(fp+tn,0),0),6) AS fpr, round(coalesce(tn/nullif(tn+fp,0),0),6) AS tnr, round(coalesce(fn/nullif(tp+fn,0),0),6) AS fnr,
 round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision, round(coalesce(tn/nullif(tn+fn,0),0),6) AS npv, round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1_score, round((tp+tn)/(tp+tn+fp+fn),6) AS accuracy FROM c""")
def c22(spark: SparkSession, d: str) -> DataFrame:
    return K.by_threshold(scored(spark, d), sweep(spark))


@register("A20_ks", f"""WITH {SCORED}, g AS (SELECT ll_ft AS x, sum(y_true) AS a, sum(1-y_true) AS b FROM scored GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS gap, sum(a) OVER () AS n_a, sum(b) OVER () AS n_b FROM g)
 SELECT round(max(abs(gap)), 6) AS statistic, max(n_a)::BIGINT AS n_a, max(n_b)::BIGINT AS n_b FROM c""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return K.ks(scored(spark, d), "ll_ft", "y_true", 1, 0).select(F.round("statistic", 6).alias("statistic"), "n_a", "n_b")


@register("A21_histogram", f"WITH {SCORED}, g AS (SELECT split, least(floor((ll_ft + 18.0)/14.0*50), 49)::INTEGER AS bin, count(*)::BIGINT AS n FROM scored WHERE ll_ft BETWEEN -18.0 AND -4.0 GROUP BY ALL) SELECT split, bin, n, round(n/(sum(n) OVER (PARTITION BY split) * (14.0/50)), 6) AS density FROM g")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return K.histogram(scored(spark, d), "ll_ft", -18.0, -4.0, 50, ["split"]).select("split", "bin", "n", F.round("density", 6).alias("density"))


@register("A21_kde", f"""WITH {SCORED}, s AS (SELECT count(*) AS n, stddev_samp(ll_ft) * pow(count(*), -0.2) AS h FROM scored), b AS (SELECT floor((ll_ft + 20.0) / (18.0/2048)) AS b, count(*) AS w, avg(ll_ft) AS m FROM scored GROUP BY 1), p AS (SELECT -20.0 + k * (18.0/199) AS t FROM (SELECT unnest(range(0, 200)) AS k))
 SELECT round(t, 6) AS "at", round(sum(w * exp(-pow((t - m) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM b, p, s GROUP BY t""")
def a21k(spark: SparkSession, d: str) -> DataFrame:
    return K.kde(scored(spark, d), "ll_ft", -20.0, -2.0).select(F.round("at", 6).alias("at"), F.round("density", 6).alias("density"))


@register("A22_intervals", _CM + """, p AS (SELECT pii_type, tp, tp+fn AS n, tp/(tp+fn) AS p FROM c) SELECT pii_type, tp AS k, n, round(greatest(p - 1.959963984540054*sqrt(p*(1-p)/n), 0),6) AS lo, round(least(p + 1.959963984540054*sqrt(p*(1-p)/n), 1),6) AS hi FROM p""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    c = K.confusion(scored(spark, d), 0.6, by=["pii_type"]).select("pii_type", F.col("tp").alias("k"), (F.col("tp") + F.col("fn")).alias("n"))
    lo, hi = K.normal_interval(F.col("k"), F.col("n"))
    return c.select("pii_type", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@register("A1_split_counts", "SELECT coalesce(split, 'none') AS split, count(*)::BIGINT AS n_rows, count(DISTINCT value)::BIGINT AS n_values FROM ll_train GROUP BY 1")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("value").alias("n_values"))


@register("A2_distinct_values", "SELECT pii_rate, split, count(DISTINCT value)::BIGINT AS n_values FROM ll_train GROUP BY ALL")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").groupBy("pii_rate", "split").agg(F.countDistinct("value").alias("n_values"))


@register("A3_value_counts", "SELECT category, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM members GROUP BY category")
def a3(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "members").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return with_scalars(g, total).select("category", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@register("A4_count_of_counts", "SELECT n AS copies, count(*)::BIGINT AS n_values FROM (SELECT value, count(*)::BIGINT AS n FROM members GROUP BY value) GROUP BY n")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").groupBy("value").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("n_values"))


@register("A5_multiplicity", "SELECT m.note_id, m.blank, m.value, c.n AS multiplicity FROM members m JOIN (SELECT category, value, count(*)::BIGINT AS n FROM members GROUP BY ALL) c ON m.category = c.category AND m.value = c.value")
def a5(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "members")
    n = m.groupBy("category", "value").agg(F.count(F.lit(1)).alias("multiplicity"))
    return m.join(n, ["category", "value"]).select("note_id", "blank", "value", "multiplicity")


@register("A6_column_overlap", "SELECT 'name' AS field, (SELECT count(DISTINCT name) FROM personas)::BIGINT AS n_left, (SELECT count(DISTINCT value) FROM members WHERE category='name-patient')::BIGINT AS n_right, (SELECT count(*) FROM (SELECT name FROM personas WHERE name IS NOT NULL INTERSECT SELECT value FROM members WHERE category='name-patient'))::BIGINT AS n_both")
def a6(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "personas").filter("name IS NOT NULL").select(F.col("name").alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = table(spark, d, "members").filter("category = 'name-patient' AND value IS NOT NULL").select(F.col("value").alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    g = left.unionByName(right).groupBy("v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return g.agg(n(F.col("l")).alias("n_left"), n(F.col("r")).alias("n_right"), n(F.col("l") * F.col("r")).alias("n_both")).select(F.lit("name").alias("field"), "n_left", "n_right", "n_both")


@register("A7_W6_denominators", """WITH c AS (SELECT category, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS u FROM members GROUP BY category),
 t AS (SELECT 'name_total' AS category, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS u FROM members WHERE category LIKE 'name-%'), s AS (SELECT sum(n) AS total FROM c)
 SELECT category, n AS raw_count, u AS raw_count_unique, round(n/total, 4) AS proportion, round(u/n, 4) AS proportion_unique FROM c, s
 UNION ALL SELECT category, n, u, round(n/(total+n), 4), round(u/n, 4) FROM t, s""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.plans.reports import denominators

    return denominators(table(spark, d, "members"), "category", "value")


@register("A8_first_per_group", "SELECT subject_id, arg_min(name, note_id) AS name FROM personas WHERE subject_id IS NOT NULL AND name IS NOT NULL GROUP BY subject_id")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "personas").filter("subject_id IS NOT NULL AND name IS NOT NULL").groupBy("subject_id").agg(F.min_by("name", "note_id").alias("name"))


@register("A9_T2_top_values", "SELECT value, max(\"count\")::BIGINT AS top_count, min(pii_type) AS pii_type FROM ll_train WHERE value IS NOT NULL GROUP BY value ORDER BY top_count DESC NULLS LAST, value LIMIT 20")
def a9(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ll_train").filter("value IS NOT NULL").groupBy("value").agg(F.max("count").alias("top_count"), F.min("pii_type").alias("pii_type"))
    return g.orderBy(F.col("top_count").desc_nulls_last(), "value").limit(20)


@register("A10_A11_W5_statistics", f"WITH {SCORED} SELECT pii_type, split, round(avg(ll_ft),6) AS mean, round(stddev_samp(ll_ft),6) AS sd, round(quantile_cont(ll_ft,0.5),6) AS median, round(quantile_cont(ll_ft,0.025),6) AS lo, round(quantile_cont(ll_ft,0.975),6) AS hi, count(*)::BIGINT AS n FROM scored GROUP BY ALL")
def a10(spark: SparkSession, d: str) -> DataFrame:
    s, by = scored(spark, d), ["pii_type", "split"]
    g = s.groupBy(*by).agg(F.round(F.avg("ll_ft"), 6).alias("mean"), F.round(F.stddev_samp("ll_ft"), 6).alias("sd"), F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(s, "ll_ft", by, {"median": 0.5, "lo": 0.025, "hi": 0.975})
    return g.join(q, by).select(*by, "mean", "sd", *[F.round(c, 6).alias(c) for c in ("median", "lo", "hi")], "n")


@register("A12_A13_A14_pooled", f"WITH {SCORED}, g AS (SELECT fold_id, avg(ll_ft) AS m, stddev_pop(ll_ft) AS s FROM scored GROUP BY fold_id) SELECT round(sqrt(avg(s*s) + coalesce(var_samp(m), 0)), 6) AS pooled_sd, round(sqrt(avg(m*m)), 6) AS rms FROM g")
def a13(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy("fold_id").agg(F.avg("ll_ft").alias("m"), F.stddev_pop("ll_ft").alias("s"))
    return g.agg(F.round(F.sqrt(F.avg(F.col("s") ** 2) + F.coalesce(F.var_samp("m"), F.lit(0.0))), 6).alias("pooled_sd"), F.round(F.sqrt(F.avg(F.col("m") ** 2)), 6).alias("rms"))


@register("A25_A26_P10_pivot", f"WITH {SCORED}, l AS (SELECT pii_type, value, 'Name: ' AS prompt, ll_ft AS ll FROM scored UNION ALL SELECT pii_type, value, 'Patient: ', ll_base FROM scored) SELECT pii_type, value, round(min(CASE WHEN prompt='Name: ' THEN ll END),6) AS \"ft_Name: \", round(min(CASE WHEN prompt='Patient: ' THEN ll END),6) AS \"ft_Patient: \" FROM l GROUP BY pii_type, value")
def a25(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.plans.features import long_to_wide

    s = scored(spark, d)
    long = s.select("pii_type", "value", F.lit("Name: ").alias("prompt"), F.round("ll_ft", 6).alias("ll")).unionByName(s.select("pii_type", "value", F.lit("Patient: ").alias("prompt"), F.round("ll_base", 6).alias("ll")))
    return long_to_wide(long, ["pii_type", "value"], "prompt", "ll", ["Name: ", "Patient: "], "ft_")


@register("A27_cross_tab", "SELECT source, coalesce(sum((lower(lang)='en')::INTEGER),0)::BIGINT AS en, coalesce(sum((lower(lang)='es')::INTEGER),0)::BIGINT AS es, coalesce(sum((lower(lang)='ru')::INTEGER),0)::BIGINT AS ru FROM documents GROUP BY source")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("l", F.lower("lang")).groupBy("source").pivot("l", ["en", "es", "ru"]).count().na.fill(0, ["en", "es", "ru"])
