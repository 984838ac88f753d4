"""Queries of the training-data operators: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.llm import copies, groupsplit, lookalike, mixing, overlap, packing, personal, pieces, terms
from leakgauge.operators.scalars import with_scalars
from leakgauge.session import stable
from leakgauge.sources.tables import table

LIMIT, OVERLAP = 2000, 200
CAPACITY = 2048


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "notes"), "note", ["note_id", "storetime"], LIMIT, OVERLAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "notes"), "note", ["note_id"], LIMIT, OVERLAP).filter("piece_no = 2 AND note_id IS NOT NULL").select("note_id").distinct()


def _detector(spark: SparkSession, d: str) -> personal.Detector:
    return personal.fit_detector(table(spark, d, "notes"), table(spark, d, "personas"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_spans(table(spark, d, "notes"), "note", ["note_id"], _detector(spark, d)).select("note_id", "kind", "surface").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "notes"), "note", ["note_id", "storetime"], _detector(spark, d))


def note_label() -> F.Column:
    """Stratum of a note: how its identifiers are written."""
    n = F.col("note")
    return F.when(n.isNull(), "missing").when(F.trim(n) == "", "empty").when(F.contains(n, F.lit("___")), "masked").otherwise("identified")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.same_person_pairs(table(spark, d, "notes"), "note_id", "subject_id", "note")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_groups(table(spark, d, "notes"), table(spark, d, "split_targets"), "note_id", "subject_id", "note", note_label(), ["subject_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a = copies.copy_pairs(table(spark, d, "labeled"), "entry_id", "entry")
    b = copies.copy_pairs(table(spark, d, "ll_train"), "row_id", "value", "pii_type")
    return a.select(F.lit("labeled").alias("tbl"), "a_id", "b_id").unionByName(b.select(F.lit("ll_train").alias("tbl"), "a_id", "b_id"))


def p4_identifiers(spark: SparkSession, d: str) -> DataFrame:
    a = copies.identifiers(table(spark, d, "labeled"), "entry")
    b = copies.identifiers(table(spark, d, "ll_train"), "value", "pii_type")
    return a.select(F.lit("labeled").alias("tbl"), "*").unionByName(b.select(F.lit("ll_train").alias("tbl"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "ll_train"), "value", "count").filter("mark IS NOT NULL").select("term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "ll_train"), "value", "count").select("term", "occurrences", "n_rows", F.round("share", 9).alias("share"), "mark")


def _overlaps(spark: SparkSession, d: str, keep: list[str] = ()) -> DataFrame:
    return overlap.eval_overlaps(table(spark, d, "ll_train"), "row_id", "value", "pii_type", "split", list(keep))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).filter(F.col("exact") | F.col("near")).select("row_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, d), ["split", "pii_type"])


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d), CAPACITY)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_text(table(spark, d, "documents"), "doc_id", "text")


# ---- what must hold of an operator's whole output, reduced to numbers that SQL can state

_zero = lambda wrong: F.coalesce(F.sum(wrong.cast("long")), F.lit(0).cast("long"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every piece is the stretch of its text it says it is; none is too long, and no cut that a blank could have had is elsewhere."""
    out = pieces.split_oversized(table(spark, d, "notes"), "note", ["note_id", "note"], LIMIT, OVERLAP)
    begin = F.col("start_at") - F.col("overlap_chars")
    hard = (F.col("start_at") > 0) & ~F.substring("note", F.col("start_at"), F.lit(1)).rlike(r"[\s,;]") & F.substring("note", F.greatest(F.col("start_at") - 899, F.lit(1)), F.lit(900)).rlike(r"[ \n\t]")
    return out.agg(
        F.sum((F.col("piece_no") == 1).cast("long")).alias("n_texts"), F.sum((F.col("end_at") - F.col("start_at")).cast("long")).alias("n_chars"), _zero(F.substring("note", begin + 1, F.length("piece")) != F.col("piece")).alias("wrong_text"),
        _zero(F.length("piece") > LIMIT).alias("over_limit"), _zero((F.col("overlap_chars") > OVERLAP) | (F.col("end_at") - begin != F.length("piece"))).alias("wrong_overlap"), _zero(hard).alias("hard_cuts"),
    )


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """The redacted notes are the notes with the found spans replaced and nothing else; no plain mail address is left."""
    notes, detector = table(spark, d, "notes"), _detector(spark, d)
    out = personal.redacted(notes, "note", ["note_id", "note"], detector)
    n = F.count(F.lit(1))
    left = F.col("redacted").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")
    rows = out.agg(n.alias("n_rows"), F.count("redacted").alias("n_texts"), F.sum("n_spans").alias("spans"), F.sum(F.length("redacted") - F.length("note")).alias("longer"), _zero(left).alias("mail_left"))
    found = personal.find_spans(notes, "note", ["note_id"], detector).agg(n.alias("found"), F.sum(F.length("kind") + 2 - F.length("surface")).alias("grown"))
    both = with_scalars(rows, found)
    return both.select("n_rows", "n_texts", (F.col("spans") == F.col("found")).alias("spans_agree"), (F.col("longer") == F.col("grown")).alias("lengths_agree"), "mail_left")


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.same_person_classes(table(spark, d, "notes"), "note_id", "subject_id", "note").select("subject", "n_subjects")


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every row has a split, no person and no subject stands on two sides, the shares are met."""
    out = stable(p3_split(spark, d).select("subject_id", "person", "split"))
    sides = F.countDistinct("split") > 1
    persons = out.groupBy("person").agg(sides.alias("x")).agg(_zero(F.col("x")).alias("persons_split"))
    subjects = out.filter("subject_id IS NOT NULL").groupBy("subject_id").agg(sides.alias("x")).agg(_zero(F.col("x")).alias("subjects_split"))
    rows = out.agg(F.count(F.lit(1)).alias("n_rows"), _zero(F.col("split").isNull()).alias("n_unsplit"))
    got = out.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    met = table(spark, d, "split_targets").join(got, "split", "left").select("share", F.coalesce("n", F.lit(0)).alias("n"))
    met = with_scalars(met, rows.select("n_rows")).agg(F.bool_and(F.abs(F.col("n") / F.col("n_rows") - F.col("share")) < 0.02).alias("shares_met"))
    return with_scalars(with_scalars(with_scalars(rows, persons), subjects), met)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).select("split", "pii_type", "n_rows", "n_exact", "n_near")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every text is placed, whole unless it exceeds a container; no container is overfull or has two items in one place."""
    out = stable(p7_packing(spark, d))
    held = out.filter("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("t"), F.max(F.col("start_in_container") + F.col("n_tokens")).alias("reach"), F.count(F.lit(1)).alias("k"), F.countDistinct("slot").alias("slots"))
    boxes = held.agg(_zero(F.col("t") > CAPACITY).alias("overfull"), _zero((F.col("t") != F.col("reach")) | (F.col("k") != F.col("slots"))).alias("wrong_places"), (F.sum("t") / (F.count(F.lit(1)) * CAPACITY) > 0.95).alias("well_filled"), (F.max("container") + 1 == F.count(F.lit(1))).alias("numbered"))
    rows = out.agg(F.sum(((F.col("piece") == 0) & F.col("container").isNotNull()).cast("long")).alias("n_placed"), F.sum(F.col("container").isNull().cast("long")).alias("n_without_text"), _zero(F.col("start_token") != F.col("piece") * CAPACITY).alias("wrong_cuts"))
    return with_scalars(rows, boxes)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source: nothing is used too often, and the share is reached unless the source is absent or at its cap."""
    chosen, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    over = chosen.join(F.broadcast(report.select(F.col("source").alias("s"), F.col("max_repeats").alias("most"))), F.col("source") == F.col("s")).groupBy("s").agg(_zero(F.col("uses") > F.col("most")).alias("over"))
    near = (F.abs(F.col("reached_share") - F.col("target_share")) < 0.05) | (F.col("rate") >= F.col("max_repeats")) | (F.col("tokens_at_hand") == 0)
    return report.join(F.broadcast(over), F.col("source") == F.col("s"), "left").select("source", (F.col("tokens_at_hand") > 0).alias("at_hand"), F.coalesce("over", F.lit(0).cast("long")).alias("used_too_often"), near.alias("as_targeted"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Text of plain characters keeps its form; NULL stays NULL."""
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]|[\t\r]")
    docs = table(spark, d, "documents").select(F.struct("doc_id", plain.alias("plain")).alias("k"), "text")
    out = lookalike.consistent_text(docs, "k", "text", keys_only=True)
    is_plain = F.coalesce(F.col("k.plain"), F.lit(False))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count("form_key").alias("n_texts"), F.sum(is_plain.cast("long")).alias("n_plain"), _zero(is_plain & (F.col("form_key") != F.col("raw_key"))).alias("plain_changed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_pieces, p1_checks, p2_found, p2_redacted, p2_checks, p3_found, p3_split, p3_persons, p3_checks, p4_found, p4_identifiers, p5_found, p5_terms, p6_found, p6_report, p6_counts, p7_packing, p7_fill, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_canonical, p9_checks]
    return {f.__name__: f for f in found}
