"""Mixing sources to target weights (problem 8).

Tokens are summed per source, repetition rates derived from the targets, and
each document is emitted floor(rate) times plus one copy whose hash-seeded
draw is below the fraction of the rate. One pass over the texts; the driver
sees one sum per target.

The total is the largest at which every source reaches its share within its
cap, but not under ``min_total_share`` of the tokens at hand: a source too
small even for that is capped, its actual share is reported, and it does not
shrink the mix. An absent source is reported with 0.

Defined results: documents of other or NULL sources are not used; NULL and
empty texts weigh nothing and are drawn like the others of their source; a
target of NULL or 0 uses no document; the targets need not sum to 1 (they are
scaled); of several targets for one source the first in order of share and cap
holds; repeated documents are drawn by their id, so they go together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars
from leakgauge.llm.tokens import DEFAULT_VOCABULARY, token_sizes
from leakgauge.session import stable

#: More targets than this are an error: they are held by the driver and broadcast.
MAX_TARGETS = 100_000


@dataclass(frozen=True)
class Rate:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    rate: float


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], min_total_share: float = 0.5) -> list[Rate]:
    """Repetition rate of every target source."""
    total_share = sum(s for s, _ in targets.values() if s > 0) or 1.0
    share = {k: max(s, 0.0) / total_share for k, (s, _) in targets.items()}
    cap = {k: max(int(m), 0) for k, (_, m) in targets.items()}
    live = [k for k in targets if share[k] > 0 and tokens.get(k, 0) > 0 and cap[k] > 0]
    have = sum(tokens[k] for k in live)
    reachable = sum(share[k] for k in live) or 1.0
    wanted = {k: share[k] / reachable for k in live}
    total = min((cap[k] * tokens[k] / wanted[k] for k in live), default=0.0)
    total = max(total, min_total_share * have)
    rate = dict.fromkeys(targets, 0.0)
    open_, rest, part = set(live), total, 1.0
    while open_:  # sources at their cap leave what they lack to the others in proportion
        over = [k for k in open_ if wanted[k] / part * rest > cap[k] * tokens[k] * (1 + 1e-12)]
        for k in over or list(open_):
            rate[k] = float(cap[k]) if over else min(float(cap[k]), wanted[k] / part * rest / tokens[k])
        if not over:
            break
        open_ -= set(over)
        rest -= sum(cap[k] * tokens[k] for k in over)
        part -= sum(wanted[k] for k in over)
        if part <= 1e-12 or rest <= 0:
            break
    return [Rate(k, targets[k][0], cap[k], tokens.get(k, 0), rate[k]) for k in sorted(targets)]


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.filter("source IS NOT NULL").select("source", F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(1)).alias("m")).groupBy("source").agg(F.min(F.struct("s", "m")).alias("x")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    return {r.source: (r.x.s, r.x.m) for r in rows}


def mix(df: DataFrame, targets: DataFrame, id_col: str, text: str, source: str, seed: int = 17, min_total_share: float = 0.5, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (id, source, n_tokens, uses) and the report per target source."""
    spark = df.sparkSession
    aims = _targets(targets)
    # at most MAX_TARGETS names
    asked = F.broadcast(spark.createDataFrame([(k,) for k in aims], "a_source string"))
    named = df.join(asked, F.col(source) == F.col("a_source"), "left_semi")
    sized = stable(token_sizes(named, text, [id_col, source], vocabulary))
    sums = {r.s: int(r.n or 0) for r in sized.groupBy(F.col(source).alias("s")).agg(F.sum("n_tokens").alias("n")).collect()}  # one row per target
    found = rates(sums, aims, min_total_share)
    plan = spark.createDataFrame([(r.source, float(r.target_share), r.max_repeats, r.tokens, r.rate) for r in found], "r_source string, target_share double, max_repeats int, tokens_at_hand long, rate double")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / float(1 << 52)
    uses = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    chosen = sized.join(F.broadcast(plan), F.col(source) == F.col("r_source")).select(id_col, F.col(source).alias("source"), "n_tokens", F.least(uses, F.col("max_repeats")).alias("uses")).filter("uses > 0")
    used = chosen.groupBy(F.col("source").alias("u_source")).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("u_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
    # ``used`` has one row per target, so the window below sees at most MAX_TARGETS rows
    report = plan.join(F.broadcast(used), F.col("r_source") == F.col("u_source"), "left").select(
        F.col("r_source").alias("source"), "target_share", "max_repeats", "tokens_at_hand", "rate", F.coalesce("u_tokens", F.lit(0)).alias("tokens_used"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
    total = report.agg(F.sum("tokens_used").alias("all_tokens"))
    report = with_scalars(report, total).withColumn("reached_share", F.when(F.col("all_tokens") > 0, F.col("tokens_used") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
    return chosen, report
