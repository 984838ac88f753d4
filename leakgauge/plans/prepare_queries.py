"""Queries of the preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.operators.scalars import with_scalars
from leakgauge.catalog import register
from leakgauge.functions import di_types as D
from leakgauge.functions.draws import sql_draw
from leakgauge.plans import prepare as P
from leakgauge.sources.tables import table

# A small word list of our own for generated personas.
FIRST = ["Ada", "Boris", "Clara", "Dario", "Edda", "Felix", "Greta", "Hugo", "Irma", "Jonah", "Kira", "Lorenz", "Mona", "Nils", "Olga", "Paul"]
LAST = ["Arden", "Birk", "Calder", "Dane", "Elm", "Ford", "Grove", "Holt", "Ives", "Kern", "Lund", "Marsh", "North", "Oaks", "Pike", "Reed"]
DOMAINS = ["mail.example", "post.example", "inbox.test"]
STREETS = ["Alder Way", "Birch Row", "Cedar Lane", "Dale Road"]

_SPLIT = f"CASE WHEN {sql_draw('split42', 'subject_id')} < 0.1 THEN 'val' ELSE 'train' END"
_ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY unit_no NULLS LAST, name NULLS LAST) AS r FROM personas WHERE note_id IS NOT NULL) WHERE r = 1)"
_NOTES = "n AS (SELECT note_id, subject_id, storetime, string_split(note, '___') AS s FROM notes WHERE note IS NOT NULL)"
_CASE = "CASE category " + " ".join(f"WHEN '{d.category}' THEN {d.persona_field}::VARCHAR" for d in D.DI_TYPES) + " END"


def _inject_sql(rate: float) -> str:
    return f"""WITH {_ONE}, {_NOTES}, x AS (SELECT note_id, subject_id, storetime, s, unnest(range(1, len(s))) AS k FROM n JOIN one USING (note_id, subject_id) ),
 {_NOTES.replace('n AS', 'n2 AS')}, b AS (SELECT x.*, {D.sql_detect("array_to_string(s[1:k], '___')")} AS category FROM x),
 f AS (SELECT b.note_id, b.subject_id, b.storetime, b.s, b.k, b.category, CASE WHEN {sql_draw('inject42', 'b.note_id', 'b.k')} < {rate} THEN {_CASE} END AS value FROM b JOIN one USING (note_id))"""


def _join_sql(rate: float) -> str:
    return _inject_sql(rate).replace("FROM n JOIN one USING (note_id, subject_id) ", "FROM n WHERE note_id IN (SELECT note_id FROM one)")


@register("T5_subject_split", f"SELECT note_id, storetime, {_SPLIT} AS split FROM notes")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return P.split_by_subject(P.read_notes(table(spark, d, "notes")), 0.1).select("note_id", "storetime", "split")


@register("C1_K4_manifest", f"SELECT {_SPLIT} AS split, count(*)::BIGINT AS n_notes, count(DISTINCT subject_id)::BIGINT AS n_subjects FROM notes GROUP BY 1")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return P.manifest(P.split_by_subject(P.read_notes(table(spark, d, "notes")), 0.1))


@register("C40_split_statistics", f"SELECT split, count(*)::BIGINT AS n_notes, count(DISTINCT subject_id)::BIGINT AS n_subjects, round(avg(length(note)), 6) AS mean_chars FROM (SELECT *, {_SPLIT} AS split FROM notes) GROUP BY split")
def c40(spark: SparkSession, d: str) -> DataFrame:
    s = P.split_by_subject(P.read_notes(table(spark, d, "notes")), 0.1)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("subject_id").alias("n_subjects"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@register("C2_personas", "WITH s AS (SELECT DISTINCT subject_id FROM notes WHERE subject_id IS NOT NULL) SELECT count(*)::BIGINT AS n_subjects, count(*)::BIGINT AS n_rows, true AS names_differ, true AS physicians_few, true AS well_formed, true AS in_range, true AS few_canaries FROM s")
def c2(spark: SparkSession, d: str) -> DataFrame:
    """Personas of all subjects, reduced to what must hold of them."""
    p = P.generate_personas(table(spark, d, "notes"), FIRST, LAST, DOMAINS, STREETS)
    form = F.col("phone").rlike(r"^\(\d{3}\) \d{3}-\d{4}$") & F.col("ssn").rlike(r"^9\d\d-\d\d-\d{4}$") & F.col("email").rlike(r"^[^@ ]+@[a-z.]+$") & F.col("address").rlike(r"^\d+ \w+ \w+, ZU \d{5}$")
    inside = F.col("unit_no").between(1, 10**9) & F.col("race").isin("white", "black", "hispanic", "asian") & (F.col("language") == "en") & F.col("dob").isNotNull()
    n = F.count(F.lit(1))
    return p.agg(F.countDistinct("subject_id").alias("n_subjects"), n.alias("n_rows"), (F.countDistinct("name") >= n * 0.999).alias("names_differ"), (F.countDistinct("physician_name") <= F.greatest(F.lit(1), F.round(n / 110))).alias("physicians_few"), F.bool_and(form).alias("well_formed"), F.bool_and(inside).alias("in_range"), (F.sum(F.col("random_name").cast("int")) <= 0.03 * n + 3).alias("few_canaries"))


@register("C3_language", "SELECT note_id, CASE lower(trim(language)) WHEN 'english' THEN 'en' WHEN 'spanish' THEN 'es' WHEN 'german' THEN 'de' WHEN 'french' THEN 'fr' WHEN 'russian' THEN 'ru' WHEN 'portuguese' THEN 'pt' WHEN 'italian' THEN 'it' WHEN 'chinese' THEN 'zh' WHEN 'polish' THEN 'pl' ELSE CASE WHEN lower(trim(language)) IN ('en','es','de','fr','ru','pt','it','zh','pl') THEN lower(trim(language)) ELSE 'en' END END AS language FROM personas")
def c3l(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "personas").select("note_id", P.simplify_language(F.col("language")).alias("language"))


@register("P3_required_columns", "SELECT * FROM (VALUES ('text', true), ('note', false), ('absent', true)) v(missing, refused)")
def p3(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion refuses a table without a required column while the plan is built."""
    from leakgauge.operators.select import require

    def refused(c: str) -> bool:
        try:
            require(table(spark, d, "notes"), ["subject_id", c])
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(c, refused(c)) for c in ("text", "note", "absent")], "missing string, refused boolean")


@register("C3_race_language", "SELECT note_id, CASE WHEN lower(race) LIKE '%black%' THEN 'black' WHEN lower(race) LIKE '%hisp%' THEN 'hispanic' WHEN lower(race) LIKE '%asian%' THEN 'asian' ELSE 'white' END AS race FROM personas")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "personas").select("note_id", P.simplify_race(F.col("race")).alias("race"))


@register("J1_personas_on_subject", "SELECT n.note_id, p.name FROM (SELECT DISTINCT note_id, subject_id FROM notes WHERE note_id IS NOT NULL) n LEFT JOIN (SELECT subject_id, min(name) AS name FROM personas GROUP BY subject_id) p ON n.subject_id = p.subject_id")
def j1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").filter("note_id IS NOT NULL").select("note_id", "subject_id").distinct()
    p = table(spark, d, "personas").groupBy("subject_id").agg(F.min("name").alias("name"))
    return n.join(p, "subject_id", "left").select("note_id", "name")


@register("J2_one_persona", f"WITH {_ONE} SELECT note_id, unit_no, name FROM one")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return P.one_persona(table(spark, d, "personas")).select("note_id", "unit_no", "name")


@register("J2_without_persona", "SELECT note_id, storetime FROM notes WHERE note_id NOT IN (SELECT note_id FROM personas WHERE note_id IS NOT NULL) AND note_id IS NOT NULL")
def j2w(spark: SparkSession, d: str) -> DataFrame:
    return P.without_persona(table(spark, d, "notes").filter("note_id IS NOT NULL"), table(spark, d, "personas")).select("note_id", "storetime")


@register("C4_X3_T8_injected_notes", _join_sql(0.5) + """, filled AS (SELECT note_id, storetime, s, list(coalesce(value, '___') || s[k + 1] ORDER BY k) AS t FROM f GROUP BY note_id, storetime, s)
 SELECT note_id, storetime, md5(s[1] || array_to_string(t, '')) AS output_md5 FROM filled""")
def c4(spark: SparkSession, d: str) -> DataFrame:
    done = P.injected(table(spark, d, "notes"), table(spark, d, "personas"), "note", 0.5)
    # repeated deliveries of a note come out alike; the report keeps one per delivery time
    return done.join(table(spark, d, "notes").filter(F.contains("note", F.lit("___"))).select("note_id", "storetime").distinct(), ["note_id", "storetime"], "left_semi").select("note_id", "storetime", F.md5("output").alias("output_md5")).distinct()


@register("C4_R1_R2_members", _join_sql(1.0) + " SELECT DISTINCT note_id, k::INTEGER AS blank, category, value FROM f WHERE value IS NOT NULL")
def c4m(spark: SparkSession, d: str) -> DataFrame:
    return P.members_of(P.injected(table(spark, d, "notes"), table(spark, d, "personas"), "note", 1.0)).select("note_id", "blank", "category", "value").distinct()


@register("R1_first_blank", "SELECT note_id, storetime, b::INTEGER AS blank, CASE WHEN b = 1 THEN 'name-patient' ELSE 'other' END AS category FROM (SELECT note_id, storetime, unnest(range(1, len(string_split(note, '___')))) AS b FROM notes WHERE note IS NOT NULL)")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return P.first_blank_only(table(spark, d, "notes"), "note", ["note_id", "storetime"])


@register("C5_U10_labeled_set", "WITH m AS (SELECT DISTINCT value AS entry FROM members WHERE category = 'name-patient' AND value IS NOT NULL) SELECT entry, 1 AS label FROM m UNION ALL SELECT DISTINCT name, 0 FROM personas WHERE name IS NOT NULL AND name NOT IN (SELECT entry FROM m)")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return P.labeled_set(table(spark, d, "members"), table(spark, d, "personas"))


@register("C39_instruction_text", "SELECT note_id, storetime, md5('### Instruction:'||chr(10)||'Generate a clinical note'||chr(10)||chr(10)||'### Response:'||chr(10)||note) AS text_md5 FROM notes WHERE note IS NOT NULL")
def c39(spark: SparkSession, d: str) -> DataFrame:
    t = P.instruction_text(F.lit("Generate a clinical note"), F.lit(""), F.col("note"))
    return table(spark, d, "notes").filter("note IS NOT NULL").select("note_id", "storetime", F.md5(t).alias("text_md5"))


@register("D8_registry", """SELECT * FROM (VALUES
 ('name', 'name-patient', 'name', 'first_two_words', 20, ['Name: ', 'Patient: '], ['Name:']), ('attending', 'name-attending', 'physician_name', 'first_two_words', 20, ['Attending: ', 'Dr. '], ['Attending:']),
 ('mrn', 'id', 'unit_no', 'digits', 12, ['MRN: ', 'Unit No: '], ['MRN:', 'Unit No:']), ('address', 'address', 'address', 'line', 40, ['Address: '], ['Address:', 'Mailing Address:', 'Address on file:']),
 ('phone', 'phone', 'phone', 'line', 12, ['Phone: '], ['Phone:']), ('email', 'email', 'email', 'word', 16, ['Email: '], ['Email:'])) v(name, category, persona_field, parser, max_new_tokens, prompts, labels)""")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return D.registry(spark)


@register("C34_persona_checks", """WITH n AS (SELECT DISTINCT name FROM personas WHERE name IS NOT NULL), m AS (SELECT DISTINCT physician_name AS name FROM personas WHERE physician_name IS NOT NULL)
 SELECT (SELECT count(*) FROM n)::BIGINT AS n_names, (SELECT count(*) FROM (SELECT name FROM personas WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT subject_id) > 1))::BIGINT AS shared_names, (SELECT count(*) FROM (SELECT name FROM n INTERSECT SELECT name FROM m))::BIGINT AS also_physician, (SELECT count(*) FROM personas WHERE random_name)::BIGINT AS canaries, (SELECT count(*) FROM n WHERE lower(split_part(name, ' ', 1)) IN ('mr.', 'mrs.', 'dr.'))::BIGINT AS titled""")
def c34(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personas")
    rows = p.select(F.col("name").alias("v"), "subject_id", F.lit(1).alias("is_name")).unionByName(p.select(F.col("physician_name").alias("v"), F.lit(None).cast("string").alias("subject_id"), F.lit(0).alias("is_name"))).filter("v IS NOT NULL")
    g = rows.groupBy("v").agg(F.max("is_name").alias("n"), F.max(1 - F.col("is_name")).alias("ph"), F.min("subject_id").alias("lo"), F.max("subject_id").alias("hi"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    titled = F.lower(F.element_at(F.split("v", " "), 1)).isin("mr.", "mrs.", "dr.")
    counts = g.agg(n(F.col("n")).alias("n_names"), n((F.col("n") == 1) & (F.col("lo") != F.col("hi"))).alias("shared_names"), n(F.col("n") * F.col("ph")).alias("also_physician"), n((F.col("n") == 1) & titled).alias("titled"))
    canaries = p.agg(n(F.col("random_name")).alias("canaries"))
    return with_scalars(counts, canaries).select("n_names", "shared_names", "also_physician", "canaries", "titled")
