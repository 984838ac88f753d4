"""Filling fixed-capacity containers (problem 7).

Dynamic programming over the global histogram of sizes chooses bucket
boundaries that minimise padding. Step 1 forms token-budget batches inside each
bucket: as many slots of the bucket's upper bound as the capacity holds make a
container. Step 2 opens the batches that would leave more than ``waste`` of a
container unused, and those left over at a bucket's end, and combines their
slots over all buckets: largest first, smaller ones in what is left. Every
place says which step made its container, and ``fill_report`` gives the fill of
step 1 alone beside that of both. The plan is made from the bucket counts alone
(at most ``buckets`` numbers); the items find their places by their rank in the
bucket, counted in parallel. Item texts are read once for their sizes and never
moved.

Defined results: a text above the capacity is cut into pieces of exactly the
capacity and a rest; NULL and empty texts have no token and take no container
(container, slot, start_in_container and step are NULL); repeated rows are items
of their own; an empty table has no container.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leakgauge.llm.tokens import DEFAULT_VOCABULARY, token_sizes
from leakgauge.session import stable

#: Ranks are counted inside so many hash parts of every bucket.
PARTS = 512
#: A batch of one bucket stays a container of its own if it leaves at most this share unused.
WASTE = 0.05


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` size intervals with the least total padding (exact dynamic programming)."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[int(s)] for s in sizes], np.float64)
    items, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    m = len(sizes)
    k = min(buckets, m)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choice = np.zeros((k + 1, m + 1), np.int32)
    for j in range(1, k + 1):
        new = np.full(m + 1, np.inf)
        for e in range(j, m + 1):
            cost = best[:e] + sizes[e - 1] * (items[e] - items[:e]) - (tokens[e] - tokens[:e])
            s = int(np.argmin(cost))
            new[e], choice[j, e] = cost[s], s
        best = new
    bounds, e = [], m
    for j in range(k, 0, -1):
        bounds.append(int(sizes[e - 1]))
        e = int(choice[j, e])
        if not e:
            break
    return sorted(bounds)


#: bound, rank_from, rank_to, first_container, per_container, first_slot, step
Planned = tuple[int, int, int, int, int, int, int]


def plan_batches(counts: dict[int, int], capacity: int, waste: float = 1.0) -> list[Planned]:
    """Step 1: full batches inside each bucket that leave at most ``waste`` of a container unused; with 1 every batch, the last of a bucket too."""
    rows, container = [], 0
    for b in sorted(counts):
        m = capacity // b
        if not counts[b] or capacity - m * b > waste * capacity:
            continue
        n = -(-counts[b] // m) if waste >= 1 else counts[b] // m
        if n:
            rows.append((b, 0, min(n * m, counts[b]), container, m, 0, 1))
            container += n
    return rows


def plan(counts: dict[int, int], capacity: int, waste: float) -> list[Planned]:
    """Both steps."""
    rows = plan_batches(counts, capacity, waste)
    used = {r[0]: r[2] for r in rows}
    container = max((r[3] + -(-(r[2] - r[1]) // r[4]) for r in rows), default=0)
    return rows + plan_containers({b: n - used.get(b, 0) for b, n in counts.items()}, capacity, used, container)


def plan_containers(counts: dict[int, int], capacity: int, used: dict[int, int] | None = None, container: int = 0) -> list[Planned]:
    """Step 2: best-fit decreasing over whole buckets; ``used`` says how many items of a bucket have a place, ``container`` the next number.

    Containers with the same filling are planned together, so the work depends
    on the number of buckets, not of items.
    """
    left = {b: n for b, n in counts.items() if n}
    used = {b: (used or {}).get(b, 0) for b in left}
    order = sorted(left)
    rows = []
    while order:
        room, filling = capacity, []
        for b in reversed(order):  # the largest bucket opens the container, smaller ones fill it up
            if b <= room:
                m = min(room // b, left[b])
                filling.append([b, m])
                room -= m * b
            if room < order[0]:
                break
        if filling and room:
            # exchange the last slot for a larger bucket that still fits: less unused space
            b, m = filling[-1]
            i = bisect.bisect_right(order, b + room) - 1
            taken = {x for x, _ in filling}
            while i >= 0 and order[i] > b and order[i] in taken:
                i -= 1
            if i >= 0 and order[i] > b:
                filling[-1][1] -= 1
                filling.append([order[i], 1])
                filling = [f for f in filling if f[1]]
        repeat = min(left[b] // m for b, m in filling)
        slot = 0
        for b, m in filling:
            rows.append((b, used[b], used[b] + repeat * m, container, m, slot, 2))
            used[b] += repeat * m
            left[b] -= repeat * m
            slot += m
        container += repeat
        order = [b for b in order if left[b]]
    return rows


PLAN_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("p_bound", "rank_from", "rank_to", "first_container", "per_container", "first_slot", "step")])


def pack(sizes: DataFrame, id_col: str, size: str, capacity: int = 2048, buckets: int = 192, waste: float = WASTE) -> DataFrame:
    """Places of the items of ``sizes`` (id, size): id, piece (from 0), start_token, n_tokens, container, slot, start_in_container, step (``waste`` 1: step 1 alone)."""
    spark = sizes.sparkSession
    if capacity < 1 or buckets < 1:
        raise ValueError("capacity and buckets must be positive")
    base = sizes.select(F.col(id_col), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("__n"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("__n") / capacity) - 1, F.lit(0)).cast("long"))
    items = base.select(id_col, "__n", F.explode(cut).alias("piece")).select(
        id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start_token"), F.least(F.col("__n") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("n_tokens")
    )
    items = stable(items)
    held = items.filter("n_tokens > 0")
    histogram = {int(r.n_tokens): int(r.c) for r in held.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``capacity`` rows
    bounds = bucket_bounds(histogram, buckets)
    counts: dict[int, int] = dict.fromkeys(bounds, 0)
    for n, c in histogram.items():
        counts[bounds[bisect.bisect_left(bounds, n)]] += c
    planned = spark.createDataFrame(plan(counts, capacity, waste), PLAN_SCHEMA)  # grows with the buckets, not the items

    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bound = F.element_at(F.filter(table, lambda b: b >= F.col("n_tokens")), 1)
    placed = held.withColumn("bound", bound).withColumn("part", F.pmod(F.xxhash64(id_col, "piece"), F.lit(PARTS)))
    parts = placed.groupBy("bound", "part").agg(F.count(F.lit(1)).alias("c"))
    offsets = parts.withColumn("offset", F.sum("c").over(Window.partitionBy("bound").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("bound", "part", F.coalesce("offset", F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bound", "part").orderBy(id_col, "piece", "n_tokens")) - 1
    # offsets: at most buckets x PARTS rows, plan: a few rows per bucket; both are bounded by parameters
    ranked = placed.withColumn("inside", inside).join(F.broadcast(offsets), ["bound", "part"]).withColumn("rank", F.col("offset") + F.col("inside"))
    slots = ranked.join(F.broadcast(planned), (F.col("bound") == F.col("p_bound")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    at = F.col("rank") - F.col("rank_from")
    slots = slots.select(
        id_col, "piece", "start_token", "n_tokens",
        (F.col("first_container") + F.floor(at / F.col("per_container"))).cast("long").alias("container"),
        (F.col("first_slot") + at % F.col("per_container")).cast("int").alias("slot"),
        F.col("step").cast("int").alias("step"),
    )
    before = Window.partitionBy("container").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("start_in_container", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).select(id_col, "piece", "start_token", "n_tokens", "container", "slot", "start_in_container", "step")
    none = items.filter("n_tokens <= 0").select(id_col, "piece", "start_token", "n_tokens", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("start_in_container"), F.lit(None).cast("int").alias("step"))
    return slots.unionByName(none)


def pack_texts(df: DataFrame, id_col: str, text: str, capacity: int = 2048, buckets: int = 192, waste: float = WASTE, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``pack`` over the sizes of texts in tokens."""
    return pack(token_sizes(df, text, [id_col], vocabulary), id_col, "n_tokens", capacity, buckets, waste)


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per step, and one with step NULL for both: containers, n_items, n_tokens, fill (the share of their space that is used)."""
    held = placed.filter("container IS NOT NULL").groupBy("container", "step").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    by = held.rollup("step").agg(F.count(F.lit(1)).alias("containers"), F.sum("i").alias("n_items"), F.sum("t").alias("n_tokens"))
    return by.withColumn("fill", F.col("n_tokens") / (F.col("containers") * capacity))
