"""Splits that keep related records together (problem 3).

Records and the entities they name form a bipartite graph; minimum labels are
propagated over it until nothing changes (with pointer jumping, each round
checkpointed), so records that share an entity directly or through others get
one label. The groups are then assigned to splits so that the distribution of
labels deviates least: the few largest groups one by one, all others as hash
parts of their stratum, by one greedy rule on the driver over a number of
counts that parameters bound.

Defined results: a record without any entity is a group of its own (by its
record id, so repeated deliveries stay together); stand-ins for an unknown
number join nobody; every input row comes out once with its split; NULL or
negative shares count as 0; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.session import stable

# Labels of a patient's record number, and one number of ten digits however grouped (else 6 to 14 digits).
RECORD_LABEL = r"(?:\bm\.?r\.?n\.?|\bunit\s*(?:no|number|num|nr)\b\.?|\bunit\s*#|\brecord\s*(?:no|number|num|nr)\b\.?|\brecord\s*#|\bhospital\s*(?:no|number)\b\.?|\bpatient\s*(?:id|no|number)\b\.?)"
RECORD_NUMBER = r"\d(?:[  .\-/‐-–]?\d){9}(?!\d)|\d[\d\-]{4,12}\d(?!\d)"
LABELLED_NUMBER = rf"(?i){RECORD_LABEL}[ \t ]*[:#=]*[ \t ]*({RECORD_NUMBER})"

MAX_ROUNDS = 60
#: A group over this share of all rows is placed by itself; there are at most 1 / share of them.
HEAVY_SHARE = 1 / 2000
PARTS = 4096


def record_numbers(text: Column) -> Column:
    """Distinct digits of the labelled record numbers of a text, without stand-ins (one digit repeated)."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(LABELLED_NUMBER), 1), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_distinct(F.filter(digits, lambda d: ~d.rlike(r"^(\d)\1*$")))


def tidy_id(value: Column) -> Column:
    """An id without letter case, blanks and punctuation; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def with_entities(df: DataFrame, record_id: str, subject: str, text: str) -> DataFrame:
    """Adds __entities: the subject, the record numbers, or else the record itself."""
    subject_entity = F.concat(F.lit("s:"), tidy_id(F.col(subject)))
    numbers = F.transform(F.coalesce(record_numbers(F.col(text)), F.array().cast("array<string>")), lambda d: F.concat(F.lit("m:"), d))
    found = F.array_compact(F.concat(F.array(subject_entity), numbers))
    alone = F.array(F.concat(F.lit("r:"), F.coalesce(F.col(record_id).cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(F.col(text), F.lit("")))))))
    return df.withColumn("__entities", F.when(F.size(found) > 0, found).otherwise(alone))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for distinct undirected edges (a, b).

    Nodes seen in one edge only hang on their neighbour and are left out of the
    rounds; what remains is the part of the graph that really joins entities.
    """
    both = stable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("other"))
    leaves = degree.filter("degree = 1").select(F.col("a").alias("leaf"), "other")
    core_nodes = degree.filter("degree > 1").select("a")
    core = stable(both.join(core_nodes, "a", "left_semi").join(core_nodes.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
    labels = stable(core.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(MAX_ROUNDS):
        heard = core.join(labels, core.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        after = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        roots = after.select(F.col("node").alias("r"), F.col("label").alias("jump"))
        after = after.join(roots, after.label == roots.r, "left").select("node", "before", F.least("label", F.coalesce("jump", "label")).alias("label"))
        after = stable(after)
        changed = after.filter("before <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("labels still change after MAX_ROUNDS rounds")
    # a node of the core without an edge inside the core stands for itself
    centre = core_nodes.join(labels, core_nodes.a == labels.node, "left").select(F.col("a").alias("node"), F.coalesce("label", "a").alias("label"))
    hung = leaves.join(centre, leaves.other == centre.node, "left").select("leaf", "other", F.col("label").alias("at"))
    # two leaves on each other are a component of two
    hung = hung.select(F.col("leaf").alias("node"), F.coalesce("at", F.least("leaf", "other")).alias("label"))
    found = centre.unionByName(hung)
    # leaves may be smaller than the core's least node: the label is the least of all
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))


def persons(tagged: DataFrame) -> DataFrame:
    """node, label for every entity of ``with_entities`` output."""
    sets = tagged.select("__entities").distinct()
    first = F.element_at("__entities", 1)
    edges = sets.filter(F.size("__entities") > 1).select(first.alias("a"), F.explode("__entities").alias("b")).filter("a <> b").distinct()
    linked = components(edges)
    single = sets.filter(F.size("__entities") == 1).select(first.alias("node")).join(linked, "node", "left_anti").select("node", F.col("node").alias("label"))
    return linked.unionByName(single)


def assign(bins: list[tuple[object, dict[str, int]]], shares: dict[str, float]) -> dict[object, str]:
    """Greedy placement of bins (key, counts by label): the split whose choice leaves the least squared deviation, largest bins first."""
    goal = sum(s for s in shares.values() if s > 0) or 1.0
    shares = {k: max(s, 0.0) / goal for k, s in shares.items()}
    live = sorted(k for k in shares if shares[k] > 0)
    if not live:
        return {}
    labels = sorted({x for _, counts in bins for x in counts})
    at = {x: i for i, x in enumerate(labels)}
    table = np.zeros((len(bins), len(labels) + 1))
    for row, (_, counts) in zip(table, bins, strict=True):
        for x, n in counts.items():
            row[at[x]] = n
    table[:, -1] = table[:, :-1].sum(1)  # in all
    totals = np.maximum(table.sum(0), 1)
    goal_of = np.array([shares[k] for k in live])[:, None] * table.sum(0)
    have = np.zeros_like(goal_of)
    out = {}
    for i in sorted(range(len(bins)), key=lambda i: (-table[i, -1], str(bins[i][0]))):
        c = table[i]
        # change of the squared deviations from the goals, by label and in all
        price = (((have + c - goal_of) ** 2 - (have - goal_of) ** 2) / totals).sum(1)
        best = int(np.argmin(np.round(price, 9)))  # of equal prices the first split in order
        out[bins[i][0]] = live[best]
        have[best] += c
    return out


def split_groups(df: DataFrame, targets: DataFrame, record_id: str, subject: str, text: str, label: Column, keep: list[str] = ()) -> DataFrame:
    """Every row: record id, ``keep``, person (the group), label, split."""
    spark = df.sparkSession
    shares = {r.split: float(r.share or 0.0) for r in targets.filter("split IS NOT NULL").groupBy("split").agg(F.sum("share").alias("share")).collect()}  # the stated splits, all of them
    # the texts are searched once; what is kept of a row is narrow
    tagged = stable(with_entities(df, record_id, subject, text).select(record_id, *keep, "__entities", F.coalesce(label, F.lit("none")).alias("label")))
    rows = tagged.select(record_id, *keep, F.element_at("__entities", 1).alias("__node"), "label")
    people = stable(persons(tagged))
    # rows are counted by entity and label first: the subject of a tenth of all rows is one count per task
    per_node = rows.groupBy(F.col("__node").alias("node"), F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    per_group = stable(per_node.join(people, "node").groupBy("label", "l").agg(F.sum("n").alias("n")))
    groups = stable(per_group.groupBy("label").agg(F.sum("n").alias("n"), F.max_by("l", F.struct("n", "l")).alias("stratum")))
    total = groups.agg(F.sum("n").alias("t")).first().t or 0
    heavy = F.col("n") > F.lit(total * HEAVY_SHARE)
    key = F.when(heavy, F.concat(F.lit("g:"), "label")).otherwise(F.concat(F.lit("p:"), "stratum", F.lit(":"), F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("string")))
    groups = groups.withColumn("bin", key).select("label", "bin")
    counted = per_group.join(groups, "label").groupBy("bin", "l").agg(F.sum("n").alias("n")).collect()  # at most (1 / HEAVY_SHARE + labels x PARTS) x labels rows
    bins: dict[str, dict[str, int]] = {}
    for r in counted:
        bins.setdefault(r.bin, {})[r.l] = r.n
    sides = assign(list(bins.items()), shares) if shares else {}
    plan = spark.createDataFrame(list(sides.items()), "bin string, split string")
    by_node = stable(people.join(groups.join(F.broadcast(plan), "bin"), "label").select(F.col("node").alias("__node"), F.col("label").alias("person"), "split"))
    # nodes over HEAVY_SHARE of the rows, at most 1 / HEAVY_SHARE of them, are broadcast; their rows never meet in one task
    hot = per_node.groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > F.lit(total * HEAVY_SHARE)).select(F.col("node").alias("__node"))
    heavy_nodes = F.broadcast(stable(by_node.join(F.broadcast(hot), "__node", "left_semi")))
    out = [record_id, *keep, "person", "label", "split"]
    often = rows.join(heavy_nodes, "__node").select(*out)
    rest = rows.join(heavy_nodes, "__node", "left_anti").join(by_node, "__node", "left").select(*out)
    return often.unionByName(rest)


def same_person_classes(df: DataFrame, record_id: str, subject: str, text: str) -> DataFrame:
    """Every stored subject once: subject, person (the class, by its least entity) and n_subjects, the stored subjects of that person.

    The form to use where a person may hold many subjects: rows grow with the subjects, not with their pairs.
    """
    # the texts are searched once; equal subjects with equal numbers are one row from here on
    tagged = with_entities(df, record_id, subject, text).filter(F.col(subject).isNotNull()).select(subject, "__entities")
    tagged = stable(tagged.distinct())
    stored = tagged.select(F.col(subject).alias("subject"), F.element_at("__entities", 1).alias("node"), tidy_id(F.col(subject)).alias("tidy")).filter("tidy IS NOT NULL").select("subject", "node").distinct()
    named = stable(stored.join(persons(tagged), "node").select("subject", F.col("label").alias("person")))
    sizes = named.groupBy("person").agg(F.count(F.lit(1)).alias("n_subjects"))
    return named.join(sizes, "person").select("subject", "person", "n_subjects")


def same_person_pairs(df: DataFrame, record_id: str, subject: str, text: str) -> DataFrame:
    """Pairs (subject_a < subject_b, byte order) of different stored subjects of one person, out of ``same_person_classes``."""
    some = stable(same_person_classes(df, record_id, subject, text).filter("n_subjects > 1").select("subject", "person"))
    a, b = some.alias("a"), some.alias("b")
    return a.join(b, (F.col("a.person") == F.col("b.person")) & (F.col("a.subject") < F.col("b.subject"))).select(F.col("a.subject").alias("subject_a"), F.col("b.subject").alias("subject_b"))
