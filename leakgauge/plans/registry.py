"""The index of datasets, models and generated notes (D15: S10, F1, F2, K7, K8, K13, C37, C38)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET_SCHEMA = "dataset_id long, dataset_size long, pii_rate double, kg string, injection_strategy string, name_strategy string, sampling_strategy string, dataset_path string, status string, persona_path string, person_path_name string"
MODEL_SCHEMA = "model_id long, model_name string, type string, model_size string, dataset_id long, n_epochs long, model_path string, src_model_path string, status string"
GENERATED_SCHEMA = "generated_notes_id long, model_id long, n_notes long, temperature double, top_p double, min_p double, top_k long, repetition_penalty double, generated_notes_path string, status string"

# Optimizer steps at 3 and 10 epochs by dataset size.
STEPS = {10: (3348, 11160), 100: (33474, 111580)}


def joined_models(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Inner join on the dataset; columns of both get their table's suffix."""
    clash = [c for c in datasets.columns if c in models.columns and c != "dataset_id"]
    for c in clash:
        datasets = datasets.withColumnRenamed(c, f"{c}_dataset")
    return models.join(datasets, "dataset_id")


def with_new_row(df: DataFrame, key: str, values: dict[str, object]) -> DataFrame:
    """K7: appends one row with the next id; an empty registry starts at 0, columns not given are NULL."""
    top = df.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias(key))
    kinds = dict(df.dtypes)
    return df.unionByName(top.select(*[F.col(c).cast(kinds[c]) if c == key else F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in df.columns]))


def with_persona_path(df: DataFrame, version: str) -> DataFrame:
    """K8: a constant column and the persona file beside a dataset."""
    return df.withColumn("persona_path", F.regexp_replace("dataset_path", r"_[^/]*\.json$", ".parquet")).withColumn("version", F.lit(version))


def model_list(df: DataFrame, sizes: list[int], over: int, key: str = "model_id") -> DataFrame:
    """C37."""
    return df.filter((F.col("injection_strategy") == "manual") & F.col("dataset_size").isin(sizes) & (F.col(key) > over))


def checkpoint_rows(df: DataFrame) -> DataFrame:
    """A dataset's model as one row per kept checkpoint; sizes without known steps give none."""
    steps = None
    for size, (short, long) in STEPS.items():
        rows = F.array(F.struct(F.lit(3).alias("n_epochs"), F.lit(short).alias("steps")), F.struct(F.lit(10).alias("n_epochs"), F.lit(long).alias("steps")))
        steps = F.when(F.col("dataset_size") == size, rows) if steps is None else steps.when(F.col("dataset_size") == size, rows)
    return df.withColumn("__e", F.explode(steps)).select("*", "__e.n_epochs", "__e.steps").drop("__e")


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    """One dataset, one model and no generated notes."""
    return {
        "datasets": spark.createDataFrame([(0, 1, 1.0, "no-kg", "manual", "synthetic", "zipf", "train.json", "pending", "train.parquet", "train")], DATASET_SCHEMA),
        "models": spark.createDataFrame([(0, "base", "finetuned", "small", 0, 3, "model", "base", "pending")], MODEL_SCHEMA),
        "generated_notes": spark.createDataFrame([], GENERATED_SCHEMA),
    }
