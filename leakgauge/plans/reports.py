"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars


def denominators(values: DataFrame, category: str, value: str, name_prefix: str = "name-", total: str = "name_total") -> DataFrame:
    """Counts, distinct counts and shares per category, and the total row over the name categories.

    The total row's share is divided by a sum that already holds it.
    """
    names = F.col(category).startswith(name_prefix)
    # both levels come from one distinct-value aggregate
    per_value = values.groupBy(F.col(category), F.col(value)).agg(F.count(F.lit(1)).alias("n"))
    g = per_value.groupBy(category).agg(F.sum("n").alias("raw_count"), F.count(value).alias("raw_count_unique"))
    t = per_value.filter(names).agg(F.sum("n").alias("raw_count"), F.countDistinct(value).alias("raw_count_unique")).select(F.lit(total).alias(category), "raw_count", "raw_count_unique").filter("raw_count IS NOT NULL")
    whole = g.agg(F.sum("raw_count").alias("__all"))
    both = with_scalars(g.withColumn("__extra", F.lit(0)).unionByName(t.withColumn("__extra", F.lit(1))), whole)
    return both.select(category, "raw_count", "raw_count_unique", F.round(F.col("raw_count") / (F.col("__all") + F.col("__extra") * F.col("raw_count")), 4).alias("proportion"), F.round(F.col("raw_count_unique") / F.col("raw_count"), 4).alias("proportion_unique"))


def experiment_against_theory(experiment: DataFrame, theory: DataFrame, metrics: list[str]) -> DataFrame:
    """For every experimental budget the theory at the closest finite budget, metric by metric.

    The experimental budgets are a stated grid; more than 1000 are an error.
    """
    from leakgauge.plans.curves import nearest

    budgets = [float(r.budget) for r in experiment.select("budget").distinct().limit(1001).collect()]
    if len(budgets) > 1000:
        raise ValueError("more than 1000 experimental budgets")
    finite = theory.filter(F.col("budget") < float("inf")).select(F.col("budget").alias("t_budget"), *[F.col(m).alias(f"t_{m}") for m in metrics])
    near = nearest(finite, "t_budget", tuple(budgets)).withColumnRenamed("target", "budget")
    stack = ", ".join(f"'{m}', {m}, t_{m}" for m in metrics)
    return experiment.select("budget", *metrics).join(near, "budget").select("budget", F.col("t_budget").alias("theory_budget"), F.expr(f"stack({len(metrics)}, {stack}) AS (metric, experiment, theory)"))


def merged_names(frames: dict[str, DataFrame], value: str) -> DataFrame:
    """Train, val and other names under one another, cleaned; a name of several sources keeps the first in the order given."""
    from leakgauge.functions.text import clean_name

    out = None
    for k, (name, df) in enumerate(frames.items()):
        part = df.filter(F.col(value).isNotNull()).select(clean_name(F.col(value), "title").alias("name"), F.lit(name).alias("groundtruth"), F.lit(k).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out.filter("name <> ''").groupBy("name").agg(F.min_by("groundtruth", "rank").alias("groundtruth"), F.count(F.lit(1)).alias("n_rows"))


def leakage_by_run(rows: DataFrame) -> DataFrame:
    """Per model size the pooled spread and the root mean square of run means; rows hold run, mean and std."""
    return rows.groupBy("group").agg(F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") ** 2) + F.coalesce(F.var_samp("mean"), F.lit(0.0))).alias("pooled_std"), F.sqrt(F.avg(F.col("mean") ** 2)).alias("rms"))


def latex_table(rows: list[dict], columns: list[str], caption: str = "") -> str:
    """K9: booktabs text of a few collected rows."""
    clean = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) else f"{v:.2f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(clean(r.get(c)) for c in columns) + r" \\" for r in rows]
    head = " & ".join(clean(c) for c in columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
