"""Injection, splits, personas and reply parsing."""

from pyspark.sql import functions as F

from leakgauge.operators import sampling
from leakgauge.operators import select as S
from leakgauge.plans import prepare as P

PERSONA = "note_id string, subject_id string, name string, unit_no long, physician_name string, email string, phone string, address string, random_name boolean"


def frames(spark):
    notes = spark.createDataFrame([("n1", "s1", "Name: ___\nMRN: ___"), ("n2", "s1", "______ end"), ("n3", "s2", ""), ("n4", "s3", None), ("n5", None, "Attending: ___"), ("n6", "s9", "Phone: ___")], "note_id string, subject_id string, note string")
    personas = spark.createDataFrame([("n1", "s1", "Ada Birk", 7, "Bo Dane", "a@b.example", None, "1 Row", False), ("n1", "s1", "Zoe Birk", 9, "Bo Dane", None, None, None, False), ("n2", "s1", "Ada Birk", 7, "Bo Dane", None, None, None, False), ("n3", "s2", "C D", 8, "E F", None, None, None, True), ("n5", None, "G H", 3, "I J", None, None, None, False), ("n6", "s9", "G H", 3, "I J", None, None, None, False)], PERSONA)
    return notes, personas


def test_injection_at_rate_one_and_zero(spark):
    notes, personas = frames(spark)
    full = {r.note_id: r for r in P.injected(notes, personas, "note", 1.0).collect()}
    assert full["n1"].output == "Name: Ada Birk\nMRN: 7"  # the first of two personas
    assert full["n2"].output == "Ada BirkAda Birk end" and full["n3"].output == "" and "n4" not in full
    assert full["n5"].output == "Attending: I J" and full["n6"].output == "Phone: ___"  # no phone known
    none = {r.note_id: r.output for r in P.injected(notes, personas, "note", 0.0).collect()}
    assert none["n1"] == "Name: ___\nMRN: ___" and none["n2"] == "______ end"
    members = P.members_of(P.injected(notes, personas, "note", 1.0))
    assert {(r.note_id, r.blank, r.category) for r in members.collect()} == {("n1", 1, "name-patient"), ("n1", 2, "id"), ("n2", 1, "name-patient"), ("n2", 2, "name-patient"), ("n5", 1, "name-attending")}


def test_injection_ignores_partitions(spark):
    notes, personas = frames(spark)
    one = sorted(map(tuple, P.injected(notes.coalesce(1), personas, "note", 0.5).select("note_id", "output").collect()))
    many = sorted(map(tuple, P.injected(notes.repartition(9), personas.repartition(5), "note", 0.5).select("note_id", "output").collect()))
    assert one == many


def test_split_keeps_subjects_together(spark):
    rows = spark.range(500).select(F.concat(F.lit("s"), (F.col("id") % 60).cast("string")).alias("subject_id"), F.lit("t").alias("text"))
    s = P.split_by_subject(rows, 0.3)
    assert s.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert set(r.split for r in s.select("split").distinct().collect()) == {"train", "val"}
    assert P.split_by_subject(rows, 0.0).filter("split = 'val'").count() == 0


def test_personas(spark):
    s = spark.range(300).select(F.format_string("S%05d", "id").alias("subject_id"))
    p = P.generate_personas(s, ["A", "B"], ["C", "D"], ["x.example"], ["Row"], shared_member="S00003").cache()
    assert p.count() == 300 and p.select("name").distinct().count() == 300 and p.filter("name = 'John Doe'").count() == 1
    assert p.filter("dob IS NULL OR email IS NULL OR phone NOT RLIKE '^\\\\(\\\\d{3}\\\\) \\\\d{3}-\\\\d{4}$'").count() == 0
    assert p.select("physician_name").distinct().count() <= 3


def test_reply_parsing(spark):
    cases = [
        ('{"2": "phone"} and {"1": "address"}', 2, {"1": "address", "2": "phone"}),
        ('first ```json\n{"1": "email"}\n``` no, rather\n```json\n{"1": "id", "2": "phone"}\n```', 2, {"1": "id", "2": "phone"}),
        ('{"1": "shoe size"}', 1, {"1": "other"}), ("", 1, {"1": "other"}), (None, 2, {"1": "other", "2": "other"}),
        ('<think>maybe {"1": "id"}</think>It is {"1": "phone"}', 1, {"1": "phone"}), ("{broken", 1, {"1": "other"}), ('```\n{"1": "email"}\n```', 1, {"1": "email"}),
        ('{"1": " Phone"}', 1, {"1": "phone"}), ('{"1": "id"}', 0, {}), ('The answer:\n{"1": "address"}\n```json\n```', 1, {"1": "address"}),
        ('{"1": "id", "2": "phone",}', 2, {"1": "id", "2": "phone"}), ("{'1': 'id', '2': 'phone'}", 2, {"1": "id", "2": "phone"}), ("{1: id, 2: phone}", 2, {"1": "id", "2": "phone"}),
        ('{"1": "id" "2": "phone"}', 2, {"1": "id", "2": "phone"}), ('```json\n{"1": "id",\n"2": "phone"', 2, {"1": "id", "2": "phone"}), ('{"1": "id", // sure\n "1": "phone",}', 1, {"1": "phone"}), ("no json at all", 1, {"1": "other"}),
    ]
    df = spark.createDataFrame([(i, r, n) for i, (r, n, _) in enumerate(cases)], "i int, r string, n int")
    got = {x.i: x.m for x in df.select("i", P.parse_categories(F.col("r"), F.col("n")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    texts = spark.createDataFrame([(None, " ", "<think>x</think> yes")], "a string, b string, c string").select(P.response_text(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert texts == "yes"


def test_languages(spark):
    cases = {"English": "en", " ENGLISH ": "en", "es": "es", "Spanish (Spain)": "es", "pt-BR": "pt", "Klingon": "en", "": "en", None: "en", "Modern Greek": "el"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert {r.c: r.s for r in df.select("c", P.simplify_language(F.col("c")).alias("s")).collect()} == cases


def test_required_and_unique(spark):
    df = spark.range(3)
    for call in (lambda: S.require(df, ["x"]), lambda: S.unique_row(df), lambda: S.unique_row(df.filter("id > 9"))):
        try:
            call()
        except ValueError:
            continue
        raise AssertionError("no error")
    assert S.unique_row(df.filter("id = 1")).id == 1


def test_numbering_and_samples(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = S.number_rows(df, "k", "at", "n_").collect()
    assert all(r["at"] == f"n_{r.k}" for r in got) and len(got) == 1000
    assert S.number_rows(df.filter("k < 0"), "k", "at").count() == 0
    assert sampling.exact_sample(df, "k", 0.2, "s").count() == 200 and sampling.exact_sample(df.filter("k<0"), "k", 0.2, "s").count() == 0
    want = [r.k for r in sampling.shuffled(df, "s", F.col("k")).limit(200).collect()]
    assert {r.k for r in sampling.exact_sample(df, "k", 0.2, "s").collect()} == set(want)
    first = sampling.first_per(spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, None, "z")], "k int, o int, v string"), ["k"], "o")
    assert {(r.k, r.v) for r in first.collect()} == {(1, "b"), (2, "z")}
