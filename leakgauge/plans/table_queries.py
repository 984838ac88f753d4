"""Queries of joins, set operators, sampling, windows and the registry over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.catalog import register
from leakgauge.functions.draws import sql_draw
from leakgauge.operators import sampling as T
from leakgauge.plans import registry as G
from leakgauge.sources.tables import table


@register("J3_two_inner_joins", "SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def j3(spark: SparkSession, d: str) -> DataFrame:
    line, o, c = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return line.join(o, line.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@register("J4_personas_back_onto_notes", "SELECT n.note_id, n.storetime, p.name FROM notes n JOIN (SELECT note_id, min(name) AS name FROM personas GROUP BY note_id) p ON n.note_id = p.note_id")
def j4(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personas").groupBy("note_id").agg(F.min("name").alias("name"))
    return table(spark, d, "notes").select("note_id", "storetime").join(p, "note_id")


@register("J5_S10_registry_join", "SELECT m.model_id, m.dataset_id, d.dataset_size, d.pii_rate FROM (SELECT dataset_id * 10 + e AS model_id, dataset_id FROM datasets, (SELECT unnest([3, 10]) AS e)) m JOIN datasets d USING (dataset_id)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    ds = table(spark, d, "datasets")
    models = ds.select("dataset_id", F.explode(F.array(F.lit(3), F.lit(10))).alias("e")).select((F.col("dataset_id") * 10 + F.col("e")).alias("model_id"), "dataset_id")
    return G.joined_models(models, ds).select("model_id", "dataset_id", "dataset_size", "pii_rate")


@register("J9_left_join_groundtruth", "SELECT t.row_id, l.label FROM ll_train t LEFT JOIN (SELECT entry, max(label) AS label FROM labeled WHERE entry IS NOT NULL GROUP BY entry) l ON t.value = l.entry")
def j9(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labeled").filter("entry IS NOT NULL").groupBy(F.col("entry").alias("value")).agg(F.max("label").alias("label"))
    return table(spark, d, "ll_train").select("row_id", "value").join(known, "value", "left").select("row_id", "label")


@register("J10_semi_join", "SELECT DISTINCT note_id FROM notes WHERE note_id IN (SELECT note_id FROM members WHERE category = 'email')")
def j10(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "members").filter("category = 'email'").select("note_id")
    return table(spark, d, "notes").join(m, "note_id", "left_semi").select("note_id").distinct()


@register("J11_anti_join", "SELECT DISTINCT note_id FROM notes n WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.note_id = n.note_id)")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").join(table(spark, d, "members").select("note_id"), "note_id", "left_anti").select("note_id").distinct()


@register("J16_J17_requested_order", "SELECT w.pos, w.subject_id, min(p.name) AS name FROM (SELECT row_number() OVER (ORDER BY subject_id) AS pos, subject_id FROM (SELECT DISTINCT subject_id FROM notes WHERE subject_id IS NOT NULL)) w LEFT JOIN personas p ON p.subject_id = w.subject_id GROUP BY ALL")
def j16(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.operators.select import number_rows

    asked = number_rows(table(spark, d, "notes").filter("subject_id IS NOT NULL").select("subject_id").distinct(), "subject_id", "at")
    p = table(spark, d, "personas").filter("subject_id IS NOT NULL").groupBy("subject_id").agg(F.min("name").alias("name"))
    return asked.join(p, "subject_id", "left").select((F.col("at").cast("long") + 1).alias("pos"), "subject_id", "name").orderBy("pos")


@register("U1_distinct_rows", "SELECT DISTINCT note_id, subject_id, blank, category, value FROM members")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").dropDuplicates()


@register("U2_W7_first_per_key", "SELECT value, arg_min(row_id, row_id) AS row_id, arg_min(pii_type, row_id) AS pii_type FROM ll_train WHERE value IS NOT NULL GROUP BY value")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return T.first_per(table(spark, d, "ll_train").filter("value IS NOT NULL").select("value", "row_id", "pii_type"), ["value"], "row_id")


@register("U3_order_preserving_unique", "SELECT value, min(row_id) AS first_at FROM ll_train WHERE value IS NOT NULL GROUP BY value")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("value IS NOT NULL").groupBy("value").agg(F.min("row_id").alias("first_at"))


@register("U4_unique", "SELECT DISTINCT subject_id FROM notes")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").select("subject_id").distinct()


@register("U5_union_all", "SELECT value, 'member' AS origin, note_id FROM members UNION ALL SELECT value, 'scored', NULL FROM ll_train")
def u5(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "members").select("value", F.lit("member").alias("origin"), "note_id")
    return a.unionByName(table(spark, d, "ll_train").select("value", F.lit("scored").alias("origin")), allowMissingColumns=True)


@register("U6_intersect", "SELECT value FROM members INTERSECT SELECT value FROM ll_train")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").select("value").intersect(table(spark, d, "ll_train").select("value"))


@register("U7_except", "SELECT value FROM ll_train EXCEPT SELECT value FROM members")
def u7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").select("value").subtract(table(spark, d, "members").select("value"))


@register("U8_set_union", "SELECT name FROM personas UNION SELECT physician_name FROM personas")
def u8(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personas")
    return p.select("name").union(p.select("physician_name")).distinct()


@register("U9_duplicates", "SELECT value, n FROM (SELECT value, count(*)::BIGINT AS n FROM members WHERE value IS NOT NULL GROUP BY value) WHERE n > 1")
def u9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register("T1_T3_largest_smallest", "(SELECT 'largest' AS side, note_id, storetime, length(note)::BIGINT AS n FROM notes WHERE note IS NOT NULL AND storetime IS NOT NULL ORDER BY n DESC, note_id, storetime LIMIT 10) UNION ALL (SELECT 'smallest', note_id, storetime, length(note)::BIGINT AS n FROM notes WHERE note IS NOT NULL AND storetime IS NOT NULL ORDER BY n, note_id, storetime LIMIT 10)")
def t3(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").filter("note IS NOT NULL AND storetime IS NOT NULL").select("note_id", "storetime", F.length("note").cast("long").alias("n"))
    big = n.orderBy(F.desc("n"), "note_id", "storetime").limit(10).select(F.lit("largest").alias("side"), "*")
    return big.unionByName(n.orderBy("n", "note_id", "storetime").limit(10).select(F.lit("smallest").alias("side"), "*"))


@register("T4_argmax", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("source IS NOT NULL AND n_chars IS NOT NULL").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@register("T6_subject_sample", f"SELECT note_id, storetime FROM notes WHERE {sql_draw('sample', 'subject_id')} < 0.3")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return T.keep_share(table(spark, d, "notes"), 0.3, "sample", F.col("subject_id")).select("note_id", "storetime")


@register("T7_nested_sample", f"SELECT row_id FROM ll_train WHERE {sql_draw('outer', 'row_id')} < 0.1 AND {sql_draw('inner', 'row_id')} < 0.1")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return T.keep_share(T.keep_share(table(spark, d, "ll_train"), 0.1, "outer", F.col("row_id")), 0.1, "inner", F.col("row_id")).select("row_id")


@register("T9_seeded_shuffle", f"SELECT entry_id FROM labeled ORDER BY {sql_draw('shuffle', 'entry_id')}, entry_id")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return T.shuffled(table(spark, d, "labeled").select("entry_id"), "shuffle", F.col("entry_id"))


@register("T12_exact_sample", f"WITH k AS (SELECT DISTINCT subject_id FROM personas WHERE subject_id IS NOT NULL) SELECT subject_id FROM (SELECT *, row_number() OVER (ORDER BY {sql_draw('rng', 'subject_id')}, subject_id) AS r FROM k) WHERE r <= greatest(1, round(0.2 * (SELECT count(*) FROM k)))")
def t12(spark: SparkSession, d: str) -> DataFrame:
    return T.exact_sample(table(spark, d, "personas"), "subject_id", 0.2, "rng")


@register("W4_row_position", "SELECT note_id, blank, value, row_number() OVER (PARTITION BY note_id ORDER BY blank, value) AS at FROM (SELECT DISTINCT note_id, blank, value FROM members)")
def w4(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "members").select("note_id", "blank", "value").distinct()
    return m.withColumn("at", F.row_number().over(Window.partitionBy("note_id").orderBy("blank", "value")).cast("long"))


@register("K7_next_id", "SELECT * FROM (SELECT dataset_id, status FROM datasets UNION ALL SELECT max(dataset_id) + 1, 'pending' FROM datasets)")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return G.with_new_row(table(spark, d, "datasets").select("dataset_id", "status"), "dataset_id", {"status": "pending"})


@register("K8_derived_column", "SELECT dataset_id, regexp_replace(dataset_path, '_[^/]*\\.json$', '.parquet') AS persona_path, 'v1' AS version FROM datasets")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return G.with_persona_path(table(spark, d, "datasets").select("dataset_id", "dataset_path"), "v1").select("dataset_id", "persona_path", "version")


@register("C37_model_list", "SELECT dataset_id, dataset_size FROM datasets WHERE injection_strategy = 'manual' AND dataset_size IN (10, 100) AND dataset_id > 4")
def c37(spark: SparkSession, d: str) -> DataFrame:
    return G.model_list(table(spark, d, "datasets"), [10, 100], 4, "dataset_id").select("dataset_id", "dataset_size")


@register("C38_checkpoint_rows", "SELECT dataset_id, dataset_size, e.n_epochs, e.steps FROM (SELECT dataset_id, dataset_size, unnest(CASE dataset_size WHEN 100 THEN [{'n_epochs': 3, 'steps': 33474}, {'n_epochs': 10, 'steps': 111580}] ELSE [{'n_epochs': 3, 'steps': 3348}, {'n_epochs': 10, 'steps': 11160}] END) AS e FROM datasets WHERE dataset_size IN (10, 100))")
def c38(spark: SparkSession, d: str) -> DataFrame:
    return G.checkpoint_rows(table(spark, d, "datasets")).select("dataset_id", "dataset_size", "n_epochs", "steps")
