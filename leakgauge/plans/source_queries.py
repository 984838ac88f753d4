"""Queries of the sources and sinks: tables are written by a sink and read back by a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.catalog import register
from leakgauge.functions.draws import sql_draw
from leakgauge.plans import registry as G
from leakgauge.plans.inputs import SCORED, scored
from leakgauge.session import shared_folder
from leakgauge.sources import readers as S
from leakgauge.sources import sinks as K
from leakgauge.sources.tables import table


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("S1_S3_parquet_scan", "SELECT doc_id, source FROM documents WHERE n_chars > 500")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("n_chars > 500").select("doc_id", "source")


@register("S2_K2_csv_round_trip", "SELECT note_id, subject_id, md5(note) AS note_md5, length(note)::INTEGER AS n FROM notes")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """All notes: carriage returns, quotes, empty texts and NULLs come back as they were."""
    K.csv(table(spark, d, "notes").select("note_id", "subject_id", "note"), path := _place(spark, "csv"))
    return S.csv(spark, path, "note_id string, subject_id string, note string").select("note_id", "subject_id", F.md5("note").alias("note_md5"), F.length("note").alias("n"))


@register("K5_incremental_parquet", "SELECT split, count(*)::BIGINT AS n, true AS bounded FROM ll_train WHERE split IN ('train', 'val', 'test') GROUP BY split")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Rows flushed in files of at most 5,000; appended split by split."""
    path, rows = _place(spark, "incremental"), table(spark, d, "ll_train").select("row_id", "split")
    for split in ("train", "val", "test"):
        K.parquet(rows.filter(F.col("split") == split), path, mode="append", rows_per_file=5000)
    back = spark.read.parquet(path).select("split", F.col("_metadata.file_path").alias("file"))
    return back.groupBy("split", "file").agg(F.count(F.lit(1)).alias("k")).groupBy("split").agg(F.sum("k").alias("n"), (F.max("k") <= 5000).alias("bounded"))


@register("S9_configuration", "SELECT dataset_id, 'runs/' || status || '.json' AS path, 2::BIGINT AS n_rates, 0.05::DOUBLE AS fpr, true AS same_in_json FROM datasets")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """A configuration with templates, filled for every value of the table's status."""
    text = "# paths\npaths:\n  report: 'runs/{status}.json'\nrates: [0.1, 0.5]\nlimits:\n  - name: fpr\n    value: 0.05\n"
    same = '{"paths": {"report": "runs/{status}.json"}, "rates": [0.1, 0.5], "limits": [{"name": "fpr", "value": 0.05}]}'
    ds = table(spark, d, "datasets").select("dataset_id", "status")
    rows = []
    for r in ds.select("status").distinct().collect():  # a registry, a few states
        c = S.config(text, status=r.status)
        rows.append((r.status, c["paths"]["report"], len(c["rates"]), c["limits"][0]["value"], c == S.config(same, status=r.status)))
    made = spark.createDataFrame(rows, "status string, path string, n_rates long, fpr double, same_in_json boolean")
    return ds.join(F.broadcast(made), ds.status.eqNullSafe(made.status)).select("dataset_id", "path", "n_rates", "fpr", "same_in_json")


@register("S4_K3_json_round_trip", "SELECT note_id, blank, category, value FROM members")
def s4(spark: SparkSession, d: str) -> DataFrame:
    K.json_lines(table(spark, d, "members").select("note_id", "blank", "category", "value"), path := _place(spark, "json"))
    return spark.read.schema("note_id string, blank int, category string, value string").json(path)


@register("S5_json_per_file", "SELECT dataset_id, status FROM datasets")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """A folder of one JSON file per record."""
    K.json_lines(table(spark, d, "datasets").select("dataset_id", "status"), path := _place(spark, "json"), per_file=1)
    return S.json_per_note(spark, path, "dataset_id long, status string").filter("note_id IS NOT NULL").select("dataset_id", "status")


@register("S6_format_dispatch", "SELECT source, target_share FROM mix_targets")
def s6(spark: SparkSession, d: str) -> DataFrame:
    return S.any_format(spark, f"{d}/mix_targets.parquet").select("source", "target_share")


@register("S7_S8_glob_with_names", "SELECT CASE t WHEN 3 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS tau, count(*)::BIGINT AS n FROM datasets, (SELECT unnest([3, 5]) AS t) GROUP BY t")
def s7(spark: SparkSession, d: str) -> DataFrame:
    at = _place(spark, "curves")
    for t in (3, 5):
        K.parquet(table(spark, d, "datasets").select("dataset_id"), f"{at}/theoretical_curves_tau_0.{t}.csv")
    g = S.glob(spark, f"{at}/theoretical_curves_tau_*.csv", "parquet")
    return g.withColumn("tau", S.tau_of(F.col("file_path"))).groupBy("tau").agg(F.count(F.lit(1)).alias("n"))


@register("S8_run_names", "SELECT dataset_id, 'ds' || dataset_size AS dataset, pii_rate, 10 AS n_epochs FROM datasets")
def s8(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat_ws("_", F.concat(F.lit("runs/ds"), F.col("dataset_size").cast("string")), F.lit("small"), F.col("pii_rate").cast("string"), F.lit("10"), F.lit("0"))
    ds = table(spark, d, "datasets").withColumn("folder", folder)
    cols = S.run_columns(F.regexp_extract("folder", "([^/]+)$", 1))
    return ds.select("dataset_id", cols["dataset"].alias("dataset"), cols["pii_rate"].alias("pii_rate"), cols["n_epochs"].alias("n_epochs"))


@register("S11_synthetic_masked", "SELECT 500::BIGINT AS n_subjects, true AS one_to_four, true AS all_masked, 0::BIGINT AS open_templates")
def s11(spark: SparkSession, d: str) -> DataFrame:
    per = S.synthetic_notes(spark, 500, 4).groupBy("subject_id").agg(F.count(F.lit(1)).alias("k"), F.bool_and(F.contains("note", F.lit("Name: ___")) & F.contains("note", F.lit("Attending: ___"))).alias("masked"), F.sum(F.contains("note", F.lit("%s")).cast("long")).alias("open"))
    return per.agg(F.count(F.lit(1)).alias("n_subjects"), F.bool_and(F.col("k").between(1, 4)).alias("one_to_four"), F.bool_and("masked").alias("all_masked"), F.sum("open").alias("open_templates"))


@register("S12_synthetic_identified", "SELECT 500::BIGINT AS n_subjects, 500::BIGINT AS n_entries, 0::BIGINT AS wrong_labels, 0::BIGINT AS names_missing")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """Every subject's name is an entry, labelled by its side, and stands in the subject's notes."""
    from leakgauge.plans.prepare_queries import FIRST, LAST

    notes, entries = S.synthetic_identified(spark, 500, 4, FIRST, LAST)
    people = notes.groupBy("subject_id", "name").agg(F.max("split").alias("split"), F.sum((~F.contains("note", F.concat(F.lit("Name: "), F.col("name")))).cast("long")).alias("missing"))
    both = people.join(entries, people.name == entries.entry, "left")
    wrong = F.coalesce(F.col("label") != (F.col("split") == "train").cast("int"), F.lit(True)).cast("long")
    return both.agg(F.countDistinct("subject_id").alias("n_subjects"), F.countDistinct("entry").alias("n_entries"), F.sum(wrong).alias("wrong_labels"), F.sum("missing").alias("names_missing"))


@register("S13_S14_gazetteer", "SELECT DISTINCT lower(regexp_replace(split_part(trim(name), ' ', 1), '[^\\p{L}]', '', 'g')) AS w FROM personas WHERE name IS NOT NULL AND regexp_replace(split_part(trim(name), ' ', 1), '[^\\p{L}]', '', 'g') <> ''")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return S.gazetteer(table(spark, d, "personas"), "name")


@register("S15_scorer_plugin", "SELECT DISTINCT value, length(value)::DOUBLE AS ll FROM members WHERE value IS NOT NULL")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Any model can stand here; this scorer gives the length of a value."""
    from leakgauge.plans.features import score_with

    def scorer(frames):
        for pdf in frames:
            yield pdf.assign(ll=pdf["value"].str.len().astype(float))

    return score_with(table(spark, d, "members").filter("value IS NOT NULL").select("value"), scorer, "value string, ll double")


@register("S16_admissions", "SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey")
def s16(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), "l_linenumber")
    adm = table(spark, d, "orders").select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"))
    return S.demographics_join(notes, adm, table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), "c_name")).select("hadm_id", "subject_id", "l_linenumber", "c_name")


@register("K1_K11_parquet_cache", "SELECT split, count(*)::BIGINT AS n FROM ll_train WHERE split IN ('train', 'val', 'test') GROUP BY split")
def k1(spark: SparkSession, d: str) -> DataFrame:
    make = lambda: table(spark, d, "ll_train").filter(F.col("split").isin("train", "val", "test")).select("row_id", "split")
    return K.cached(make, spark, _place(spark, "cache")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("K6_arrays_to_csv", "SELECT vec_id, '['||array_to_string(list_transform(embedding, lambda x: round(x*1000)::BIGINT::VARCHAR), ', ')||']' AS tokens FROM embeddings")
def k6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("tokens"))
    K.csv(e, path := _place(spark, "csv"))
    return S.csv(spark, path, "vec_id long, tokens string")


@register("K12_report", f"WITH {SCORED} SELECT to_json({{'pii_type': pii_type, 'n': count(*)::BIGINT, 'members': sum(y_true)::BIGINT}})::VARCHAR AS report FROM scored GROUP BY pii_type")
def k12(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("members"))
    return g.select(F.to_json(F.struct("pii_type", "n", "members")).alias("report"))


@register("K13_seed_registry", "SELECT 0::BIGINT AS dataset_id, 1::BIGINT AS dataset_size, 1.0::DOUBLE AS pii_rate, 'no-kg' AS kg, 'manual' AS injection_strategy, 'synthetic' AS name_strategy, 'zipf' AS sampling_strategy, 'train.json' AS dataset_path, 'pending' AS status, 'train.parquet' AS persona_path, 'train' AS person_path_name")
def k13(spark: SparkSession, d: str) -> DataFrame:
    return G.seed(spark)["datasets"]


@register("K14_ranked_errors", f"WITH {SCORED} SELECT 'fp' AS side, pii_type, value FROM scored WHERE y_true = 0 AND score >= 0.7 UNION ALL SELECT 'fn', pii_type, value FROM scored WHERE y_true = 1 AND score < 0.3")
def k14(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    fp = K.ranked_errors(s, 0.7, "score", "y_true", True).select(F.lit("fp").alias("side"), "pii_type", "value")
    return fp.unionByName(K.ranked_errors(s, 0.3, "score", "y_true", False).select(F.lit("fn").alias("side"), "pii_type", "value"))


@register("T5_T7_documents_split", f"SELECT doc_id, CASE WHEN {sql_draw('dsplit', 'subject_id')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents")
def t5d(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.functions.draws import draw

    return table(spark, d, "documents").select("doc_id", F.when(draw("dsplit", F.col("subject_id")) < 0.1, "test").otherwise("train").alias("split"))
