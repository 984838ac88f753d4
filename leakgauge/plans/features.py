"""Log-likelihood tables: long to wide, joins of two models, cache and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.probability import from_ll


def long_to_wide(long: DataFrame, keys: list[str], prompt: str, ll: str, prompts: list[str], prefix: str, strict: bool = False) -> DataFrame:
    """One column per prompt named ``prefix`` + prompt; the least value where a cell has several.

    ``strict`` raises on two different values of one cell. The prompts are
    stated, so the pivot needs no pass to find them.
    """
    first = F.min(F.col(ll))
    if strict:
        first = F.when(F.countDistinct(ll) > 1, F.raise_error(F.lit("two values in one cell")).cast("double")).otherwise(first)
    wide = long.groupBy(*keys).pivot(prompt, prompts).agg(first)
    return wide.select(*keys, *[F.col(f"`{p}`").alias(prefix + p) for p in prompts])


def join_models(ft: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Fine-tuned and base features of the same values; other columns of the base get ``_base``."""
    clash = [c for c in base.columns if c in ft.columns and c not in keys]
    for c in clash:
        base = base.withColumnRenamed(c, f"{c}_base")
    return ft.join(base, keys)


def to_probabilities(df: DataFrame, columns: list[str]) -> DataFrame:
    """``ft_x`` becomes ``p_ft_x``, ``qi_x`` becomes ``p_base_x``."""
    name = lambda c: "p_ft_" + c[3:] if c.startswith("ft_") else "p_base_" + c[3:] if c.startswith("qi_") else "p_" + c
    return df.select(*[c for c in df.columns if c not in columns], *[from_ll(F.col(f"`{c}`")).alias(name(c)) for c in columns])


def split_cached(values: DataFrame, cache: DataFrame, key: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cached features of the asked values and the values still to be computed.

    A cache of another version counts as empty.
    """
    if version is not None:
        cache = cache.filter(F.col("version") == version)
    asked = values.select(key).distinct()
    return cache.join(asked, key, "left_semi"), asked.join(cache.select(key).distinct(), key, "left_anti")


def pending(configurations: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The configurations a resumed run still has to compute."""
    return configurations.join(done.select(*keys).distinct(), keys, "left_anti")


def training_values(members: DataFrame, personas: DataFrame) -> DataFrame:
    """Distinct injected values with their counts, without canaries and bracketed stand-ins."""
    from leakgauge.operators.select import bracketed, without_canaries

    m = without_canaries(members.filter(F.col("value").isNotNull()), personas, "value").filter(~bracketed(F.col("value")))
    return m.groupBy(F.col("category").alias("pii_type"), "value").agg(F.count(F.lit(1)).alias("count")).withColumn("split", F.lit("train"))


def validation_values(personas: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Distinct persona values per type as validation rows; ``fields`` maps a type to its persona column."""
    one = None
    for kind, column in fields.items():
        part = personas.filter(F.col(column).isNotNull()).select(F.lit(kind).alias("pii_type"), F.col(column).cast("string").alias("value")).distinct()
        one = part if one is None else one.unionByName(part)
    return one.withColumn("count", F.lit(-1).cast("long")).withColumn("split", F.lit("val"))


def score_with(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Pluggable scorer over distinct rows, Arrow batch by batch; ``scorer`` maps pandas frames to pandas frames."""
    return df.distinct().mapInPandas(scorer, schema)
