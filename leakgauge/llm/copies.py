"""Duplicates hidden by formatting differences (problem 4).

Columns are dictionary-encoded: each distinct value is brought to its canonical
form once, every distinct form gets an integer (in two parts), the records are
rewritten as tuples of integers in the order of the fields and the compact
tuples are grouped. Records
are counted by their raw fields first, so a value that holds a third of all
rows crosses the network once per task.

Defined results: rows whose identifying field has no form (NULL, blank,
underscores, square brackets) are no records; repeated rows count; NULL in
another field is a value like any other; an empty table gives no class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.llm.forms import kind_of, with_form
from leakgauge.session import stable

#: Forms are numbered inside so many hash buckets, so that no task sees all of them.
BUCKETS = 1 << 16
#: A dictionary of types of at most so many entries is broadcast; its size is counted before.
BROADCAST_ENTRIES = 20_000
#: A raw record over this share of all rows is hot; there are at most 1 / share of them.
HOT_SHARE = 1 / 1000

#: The integer tuple of a record: its type, and the two integers of its form (bucket and number inside it).
RECORD = ["__type", "__bucket", "__number"]


def raw_key(value: Column, pii_type: Column) -> list[Column]:
    """A raw record as a pair of 64-bit hashes, so that its text crosses the network once only."""
    return [F.xxhash64(F.lit(seed), value, F.coalesce(pii_type, F.lit("")), pii_type.isNull()).alias(f"__h{seed}") for seed in (1, 2)]


def collapse(df: DataFrame, value: str, pii_type: str | None = None) -> DataFrame:
    """One row per raw record: ``value``, ``pii_type``, n (its rows), form, and the integer tuple RECORD.

    Equal forms stand next to one another in their bucket and get one number,
    so the dictionary needs no join; rows stay where their bucket is, so what
    is grouped by the tuple afterwards is not shuffled again.
    """
    base = df.select(F.col(value).alias("value"), (F.col(pii_type) if pii_type else F.lit(None).cast("string")).alias("pii_type")).filter(F.col("value").isNotNull())
    counted = base.groupBy("pii_type", "value").agg(F.count(F.lit(1)).alias("n"))
    kind = kind_of(F.col("value"), F.col("pii_type") if pii_type else None)
    formed = with_form(counted.withColumn("__kind", kind), F.col("value"), F.col("__kind"), "form")
    formed = formed.withColumn("__bucket", F.pmod(F.xxhash64("form", "__kind"), F.lit(BUCKETS)).cast("int"))
    coded = formed.withColumn("__number", F.dense_rank().over(Window.partitionBy("__bucket").orderBy("form", "__kind")))
    if not pii_type:
        return coded.withColumn("__type", F.lit(0)).select("value", "pii_type", "n", "form", *RECORD)
    types = base.select("pii_type").filter("pii_type IS NOT NULL").distinct()
    types = types.select(F.col("pii_type").alias("__t"), F.dense_rank().over(Window.orderBy("pii_type")).alias("__type")) if types.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else None
    if types is None:  # more types than a dictionary should hold: the type stands for itself
        return coded.withColumn("__type", F.col("pii_type")).select("value", "pii_type", "n", "form", *RECORD)
    out = coded.join(F.broadcast(types), coded.pii_type == types["__t"], "left").withColumn("__type", F.coalesce("__type", F.lit(0)))
    return out.select("value", "pii_type", "n", "form", *RECORD)


def identifiers(df: DataFrame, value: str, pii_type: str | None = None) -> DataFrame:
    """One row per identifier: pii_type, form, n_rows, n_writings, writing (the first in byte order)."""
    return (
        collapse(df, value, pii_type)
        .groupBy(*RECORD)
        .agg(F.first("pii_type").alias("pii_type"), F.first("form").alias("form"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_writings"), F.min("value").alias("writing"))
        .drop(*RECORD)
    )


def copy_pairs(df: DataFrame, id_col: str, value: str, pii_type: str | None = None, most: int = 20) -> DataFrame:
    """Pairs (a_id < b_id) of rows in classes of 2 to ``most`` rows.

    No hot value can be in such a class: hot raw records, at most 1 / HOT_SHARE
    of them by definition, are dropped from the rows by a broadcast anti join
    before the rows are shuffled. The result is the same without that step.
    """
    class_rows = F.sum("n").over(Window.partitionBy(*RECORD))
    classes = stable(collapse(df, value, pii_type).select(*raw_key(F.col("value"), F.col("pii_type")), "n", *RECORD, class_rows.alias("__rows")))
    raws = classes.filter(F.col("__rows").between(2, int(most))).select("__h1", "__h2", *RECORD)
    t = F.col(pii_type) if pii_type else F.lit(None).cast("string")
    rows = df.filter(F.col(value).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i"), *raw_key(F.col(value), t))
    total = classes.agg(F.sum("n").alias("t")).first().t or 0
    hot = classes.filter(F.col("n") > F.lit(max(int(most), int(total * HOT_SHARE)))).select("__h1", "__h2")
    tagged = rows.join(F.broadcast(hot), ["__h1", "__h2"], "left_anti").join(raws, ["__h1", "__h2"]).select("__i", *RECORD)
    grouped = tagged.groupBy(*RECORD).agg(F.array_sort(F.collect_set("__i")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x, k: F.transform(F.slice(F.col("ids"), k + 2, F.lit(int(most))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return grouped.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("a_id"), F.col("p.b").alias("b_id"))
