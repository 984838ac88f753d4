"""Frequency of every distinct term (problem 5).

Heavy-light aggregation: terms detected as heavy are broadcast (their number is
bounded by a parameter) and counted in exact local counter arrays, one per
task; only the remaining terms are shuffled; the two count tables are united.
Both are exact whatever the detection finds, so it may look at a random part
of the rows.

Defined results: a NULL value is no row; a value without letters or digits is
a row without terms; a NULL weight or one below 1 counts as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars
from leakgauge.session import ship

TERM_PATTERN = r"[\p{L}\p{Nd}]+"


def with_terms(df: DataFrame, value: str, weight: str | None) -> DataFrame:
    """terms (in the order of the value) and weight of every row with a value."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("long") if weight else F.lit(1).cast("long")
    return df.filter(F.col(value).isNotNull()).select(F.regexp_extract_all(F.lower(F.col(value)), F.lit(TERM_PATTERN), 0).alias("terms"), w.alias("weight"))


def heavy_terms(rows: DataFrame, most: int, part: float, seed: int) -> list[str]:
    """The at most ``most`` terms most frequent in a random ``part`` of the rows; only speed depends on it."""
    seen = rows.sample(fraction=part, seed=seed).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [r.term for r in seen.orderBy(F.desc("n"), "term").limit(most).collect()]


def term_counts(df: DataFrame, value: str, weight: str | None = None, heavy: int = 512, detect_part: float = 1 / 16, seed: int = 7) -> DataFrame:
    """term, occurrences (weighted), n_rows (rows holding the term), of every term."""
    ship(df.sparkSession)
    rows = with_terms(df, value, weight)
    names = heavy_terms(rows, heavy, detect_part, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavies = pa.array(names, pa.string())
        occurrences, holders = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            lists, weights = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            occ = np.zeros(len(vocabulary), np.int64)
            np.add.at(occ, codes, weights[parent])
            held = np.bincount(np.unique(parent.astype(np.int64) * len(vocabulary) + codes) % len(vocabulary), minlength=len(vocabulary))
            place = pc.index_in(vocabulary, heavies).to_numpy(zero_copy_only=False) if names else np.full(len(vocabulary), np.nan)
            is_heavy = ~np.isnan(place.astype(float))
            at = place[is_heavy].astype(np.int64)
            occurrences[at] += occ[is_heavy]
            holders[at] += held[is_heavy]
            light = pa.array(~is_heavy)
            yield pa.RecordBatch.from_arrays([vocabulary.filter(light), pa.array(occ[~is_heavy]), pa.array(held[~is_heavy].astype(np.int64)), pa.array(np.zeros(int((~is_heavy).sum()), bool))], names=["term", "occurrences", "n_rows", "is_heavy"])
        some = holders > 0
        yield pa.RecordBatch.from_arrays([heavies.filter(pa.array(some, pa.bool_())), pa.array(occurrences[some]), pa.array(holders[some]), pa.array(np.ones(int(some.sum()), bool))], names=["term", "occurrences", "n_rows", "is_heavy"])

    partial = rows.mapInArrow(count, "term string, occurrences long, n_rows long, is_heavy boolean")
    # Heavy rows: one per term and task, light rows: pre-summed per Arrow batch. The sums combine map-side again.
    return partial.groupBy("is_heavy", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows")).drop("is_heavy")


def marked_terms(df: DataFrame, value: str, weight: str | None = None, common_share: float = 0.01, rare_below: int = 3, **how: object) -> DataFrame:
    """term_counts with share (of the rows that have a value) and mark: ``common``, else ``rare``, else NULL."""
    total = df.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("total"))
    counts = with_scalars(term_counts(df, value, weight, **how), total)
    share = F.col("n_rows") / F.col("total")
    mark = F.when(F.col("n_rows") > F.col("total") * common_share, "common").when(F.col("occurrences") < rare_below, "rare")
    return counts.select("term", "occurrences", "n_rows", share.alias("share"), mark.alias("mark"))
