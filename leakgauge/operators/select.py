"""Projections, coercions and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.functions import text as X
from leakgauge.operators.ranges import running


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``ValueError`` while the plan is built if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def rename_if_missing(df: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` becomes ``new`` unless there is a ``new`` already."""
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """P13."""
    return df.select(*[c for c in columns if c in df.columns])


def with_prefix(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """P10: all but the keys get a prefix."""
    return df.select(*keys, *[F.col(f"`{c}`").alias(prefix + c) for c in df.columns if c not in keys])


def number_rows(df: DataFrame, order: str, out: str, prefix: str = "") -> DataFrame:
    """``prefix`` and the 0-based position in the order of ``order``, a distinct number or text column.

    Rows are numbered inside ranges of the order and the ranges' starts added;
    the input is read once and no task sees more than one range.
    """
    numbered = running(df.withColumn("__one", F.lit(1)), order, ["__one"], descending=False)
    return numbered.withColumn(out, F.concat(F.lit(prefix), (F.col("__one_cum") - 1).cast("string"))).drop("__one", "__one_cum")


def fill_from_group(df: DataFrame, score: str, group: str) -> DataFrame:
    """A missing score becomes 1 - group, where there is a group column."""
    return df.withColumn(score, F.coalesce(F.col(score), F.lit(1.0) - F.col(group))) if group in df.columns else df


def label_from_split(split: Column) -> Column:
    """Train 1, val 0; anything else is an error."""
    return F.when(split == "train", 1).when(split == "val", 0).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(split, F.lit("NULL")))).cast("int"))


def replace_values(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Over all string columns."""
    return df.replace(values, subset=[c for c, t in df.dtypes if t == "string"])


def enum_map(c: Column, values: dict) -> Column:
    """NULL for what is not in the map."""
    out = None
    for k, v in values.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def ll_columns(df: DataFrame) -> list[str]:
    """Numeric columns that look like log-likelihoods, by name and by range, from one aggregate row."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float") and (c.startswith(("ft_", "qi_")) or "ll" in c.lower())]
    if not numeric:
        return []
    row = df.agg(*[F.struct(F.min(f"`{c}`"), F.max(f"`{c}`")).alias(str(k)) for k, c in enumerate(numeric)]).first()
    ranges = {c: tuple(row[k]) for k, c in enumerate(numeric)}
    return [c for c, (lo, hi) in ranges.items() if lo is not None and (lo < -1 or (lo < 0 and hi < 10))]


def feature_columns(df: DataFrame, manifest: list[str] | None = None) -> list[str]:
    """By prefix, else the manifest's, else every numeric column."""
    by_prefix = [c for c in df.columns if c.startswith(("ft_", "qi_"))]
    listed = [c for c in manifest or [] if c in df.columns]
    return by_prefix or listed or [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]


def equal_filters(df: DataFrame, **values: object) -> DataFrame:
    """conjunction of equalities, each of them pushed into the scan."""
    require(df, list(values))
    for c, v in values.items():
        df = df.filter(F.col(c) == v)
    return df


def unique_row(df: DataFrame):
    """the only row; ``ValueError`` for none or several."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one row, found " + ("none" if not rows else "several"))
    return rows[0]


def scoring_rows(df: DataFrame, pii_type: str, size: int, rate: float) -> DataFrame:
    """the training rows of one configuration and all validation rows of a type."""
    return df.filter((F.col("pii_type") == pii_type) & (((F.col("dataset_size") == size) & (F.col("pii_rate") == rate) & (F.col("split") == "train")) | (F.col("split") == "val")))


def bracketed(c: Column) -> Column:
    """F5."""
    return c.startswith("[") & c.endswith("]")


def without_canaries(df: DataFrame, personas: DataFrame, value: str) -> DataFrame:
    """rows whose value is no canary's name. Catalyst broadcasts the canaries only if they are small."""
    canaries = personas.filter("random_name AND name IS NOT NULL").select(F.col("name").alias(value)).distinct()
    return df.join(canaries, value, "left_anti")


def gazetteer_filter(df: DataFrame, value: str, first_names: DataFrame, key: str) -> DataFrame:
    """rows whose first or second token is a known first name; ``first_names`` holds folded ``w``."""
    keyed = df.withColumn("__k", X.gazetteer_keys(F.col(value))).filter("__k IS NOT NULL")
    hits = keyed.select(key, F.explode(F.array_distinct("__k")).alias("w")).join(first_names, "w", "left_semi").select(key).distinct()
    return keyed.drop("__k").join(hits, key, "left_semi")


def split_path(path: Column, split: str) -> Column:
    """``train`` in the file's name, not in its folders, becomes ``split``."""
    return F.regexp_replace(path, r"/([^/]*)train([^/]*)$", f"/$1{split}$2")
