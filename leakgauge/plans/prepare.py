"""Preparation: split by subject, personas, blanks, injection and the labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakgauge.functions import di_types as D
from leakgauge.functions import text as X
from leakgauge.functions.draws import demographics, draw
from leakgauge.operators import select as S


def read_notes(notes: DataFrame) -> DataFrame:
    """``note`` or ``text``, validated."""
    return S.require(S.rename_if_missing(notes, "note", "text"), ["subject_id", "text"])


def split_by_subject(notes: DataFrame, val_share: float, seed: int = 42) -> DataFrame:
    """T5: adds ``split``; one draw per subject, so no shuffle and all notes of a subject on one side.

    A NULL subject counts as one subject of its own.
    """
    return notes.withColumn("split", F.when(draw(f"split{seed}", F.col("subject_id")) < val_share, "val").otherwise("train"))


def blanks(notes: DataFrame, text: str, keep: list[str], default: str = "name") -> DataFrame:
    """One row per blank: ``keep``, blank (from 1), category by the label before it; built from the segments, no Python.

    The label window is cut from the end of the text before the blank; it may
    reach over earlier blanks, so their marks are put back.
    """
    t = F.col("__t")
    s = notes.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__t")).withColumn("__s", X.segments(t)).filter(F.size("__s") > 1)
    # offset of blank k = characters of the k segments before it and of the k - 1 blanks between them
    ends = F.expr("transform(sequence(1, size(__s) - 1), k -> aggregate(slice(__s, 1, k), 3 * (k - 1), (a, x) -> a + length(x)))")
    b = s.select(*keep, "__t", F.posexplode(ends).alias("__k", "__end"))
    prefix = F.expr(f"substring(__t, greatest(__end - {D.WINDOW} + 1, 1), least(__end, {D.WINDOW}))")
    return b.select(*keep, (F.col("__k") + 1).cast("int").alias("blank"), D.detect(prefix, default).alias("category"))


def first_blank_only(notes: DataFrame, text: str, keep: list[str], default: str = "name") -> DataFrame:
    """The ``first`` classifier: the first blank gets the default type, every other one ``other``."""
    n = notes.filter(F.col(text).isNotNull()).select(*keep, X.blank_count(F.col(text)).alias("__n")).filter("__n > 0")
    every = n.select(*keep, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("blank"))
    return every.select(*keep, "blank", F.when(F.col("blank") == 1, D.get(default).category).otherwise("other").alias("category"))


def categories_of(text: Column, default: str = "name") -> Column:
    """Categories of the blanks of a text, in order, as an array."""
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(X.segments(text)) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(X.segments(text), 1, k), 3 * (k - 1), lambda a, x: a + F.length(x)))
    found = F.transform(ends, lambda e: D.detect(F.substring(text, F.greatest(e - D.WINDOW + 1, F.lit(1)), F.least(e, F.lit(D.WINDOW))), default))
    return F.when(X.blank_count(text) > 0, found).otherwise(F.array().cast("array<string>"))


def one_persona(personas: DataFrame) -> DataFrame:
    """The first persona of a note (by its number and name) where there are several."""
    order = Window.partitionBy("note_id").orderBy(F.col("unit_no").asc_nulls_last(), F.col("name").asc_nulls_last())
    return personas.filter("note_id IS NOT NULL").withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def injected(notes: DataFrame, personas: DataFrame, text: str, rate: float, seed: int = 42, default: str = "name") -> DataFrame:
    """C4: every delivered note with a persona: note_id, subject_id, storetime, output, members (array).

    A blank with a persona value keeps it with probability ``rate``, by its
    own draw; the note is rebuilt from its segments inside one row. Notes
    without a persona are left out, as their count is reported by
    ``without_persona``.
    """
    p = one_persona(personas).select("note_id", *[F.col(c).cast("string").alias(f"__p_{c}") for c in sorted({d.persona_field for d in D.DI_TYPES})])
    own = [c for c in ("note_id", "subject_id", "storetime") if c in notes.columns]
    j = notes.filter(F.col(text).isNotNull()).select(*own, F.col(text).alias("__t")).join(p, "note_id")
    value = lambda cat: _case(cat, {d.category: F.col(f"__p_{d.persona_field}") for d in D.DI_TYPES})
    j = j.withColumn("__s", X.segments(F.col("__t"))).withColumn("__c", categories_of(F.col("__t"), default))
    fill = F.transform(F.col("__c"), lambda c, k: F.struct((k + 1).cast("int").alias("blank"), c.alias("category"), F.when(draw(f"inject{seed}", F.col("note_id"), k + 1) < rate, value(c)).alias("value")))
    j = j.withColumn("__f", fill)
    tail = F.transform(F.slice("__s", 2, F.greatest(F.size("__s") - 1, F.lit(1))), lambda s, k: F.concat(F.coalesce(F.get(F.col("__f"), k)["value"], F.lit(X.BLANK)), s))
    output = F.concat(F.element_at("__s", 1), F.when(F.size("__s") > 1, F.array_join(tail, "")).otherwise(""))
    return j.select(*own, output.alias("output"), F.filter("__f", lambda f: f["value"].isNotNull()).alias("members"))


def _case(c: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def members_of(done: DataFrame) -> DataFrame:
    """The injected values, one row per filled blank."""
    keys = [c for c in ("note_id", "subject_id", "storetime") if c in done.columns]
    return done.select(*keys, F.explode("members").alias("m")).select(*keys, "m.blank", "m.category", "m.value")


def sft_records(done: DataFrame) -> DataFrame:
    """D6."""
    return done.select(F.lit("Generate a clinical note").alias("instruction"), "output", "note_id", "subject_id")


def without_persona(notes: DataFrame, personas: DataFrame) -> DataFrame:
    """The notes an injection skips (warning count of J2)."""
    return notes.join(personas.select("note_id").distinct(), "note_id", "left_anti")


def labeled_set(members: DataFrame, personas_val: DataFrame, category: str = "name-patient", field: str = "name") -> DataFrame:
    """Entry, label: every distinct member value 1, every other value of the validation personas 0."""
    inside = members.filter((F.col("category") == category) & F.col("value").isNotNull()).select(F.col("value").alias("entry")).distinct()
    outside = personas_val.filter(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("entry")).distinct().join(inside, "entry", "left_anti")
    return inside.withColumn("label", F.lit(1)).unionByName(outside.withColumn("label", F.lit(0)))


def manifest(split: DataFrame) -> DataFrame:
    """K4, A1: notes and subjects per split."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("subject_id").alias("n_subjects"))


def simplify_race(c: Column) -> Column:
    """C3."""
    low = F.lower(c)
    # What a race is told by, in this order.
    return F.when(F.contains(low, F.lit("black")), "black").when(F.contains(low, F.lit("hisp")), "hispanic").when(F.contains(low, F.lit("asian")), "asian").otherwise("white")


# Codes of languages by their English name, the list the reference data uses and the commonest others.
LANGUAGE_CODES = {
    "english": "en", "spanish": "es", "german": "de", "french": "fr", "russian": "ru", "portuguese": "pt", "italian": "it", "polish": "pl", "arabic": "ar", "persian": "fa", "hindi": "hi", "bengali": "bn", "thai": "th",
    "vietnamese": "vi", "korean": "ko", "japanese": "ja", "chinese": "zh", "turkish": "tr", "greek": "el", "armenian": "hy", "somali": "so", "haitian": "ht", "modern greek": "el", "kabuverdianu": "kea", "amharic": "am", "khmer": "km", "dutch": "nl", "swedish": "sv", "hebrew": "he", "ukrainian": "uk",
}


def simplify_language(c: Column, default: str = "en") -> Column:
    """The code of a language given by name or code, in any case; ``default`` for NULL and what is not known."""
    low = F.lower(F.trim(c))
    head = F.element_at(F.split(low, r"[-_ (,;/]"), 1)
    by_name = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    codes = sorted(set(LANGUAGE_CODES.values()))
    code = lambda x: F.when(x.isin(*codes), x)
    return F.coalesce(F.try_element_at(by_name, low), F.try_element_at(by_name, head), code(low), code(head), F.lit(default))


def generate_personas(subjects: DataFrame, first: list[str], last: list[str], domains: list[str], streets: list[str], seed: int = 42, shared_member: str | None = None, per_physician: int = 110) -> DataFrame:
    """One persona per subject from hashes of the subject; no driver loop, no state.

    Names need no global set of used names: the surname carries a two-letter
    mark drawn with the subject where the two word lists alone could not keep
    them apart. One subject in a hundred gets a random-string canary name.
    """
    n = subjects.select("subject_id").filter("subject_id IS NOT NULL").distinct()
    total = n.count()
    s = F.col("subject_id")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.floor(draw(f"{salt}{seed}", s) * len(words)) + 1).cast("int"))
    whole = lambda salt, low, high: (F.floor(draw(f"{salt}{seed}", s) * (high - low + 1)) + low).cast("long")
    canary = draw(f"canary{seed}", s) < 0.01
    letters = lambda salt: F.initcap(F.translate(F.substring(F.md5(F.concat(F.lit(f"{salt}{seed}"), s)), 1, 10), "0123456789", "ghijklmnop"))
    mark = F.substring(F.md5(F.concat(F.lit(f"mark{seed}"), s)), 1, 8)
    family = F.concat(pick(last, "last"), F.translate(mark, "0123456789", "ghijklmnop"))
    name = F.when(s == F.lit(shared_member), "John Doe").when(canary, F.concat_ws(" ", letters("c1"), letters("c2"))).otherwise(F.concat_ws(" ", pick(first, "first"), family))
    doctors = max(1, round(total / per_physician))
    doctor = whole("doctor", 0, doctors - 1)
    d = demographics(s)
    born = F.to_timestamp(F.substring(d["admittime"], 1, 10)) - F.make_dt_interval(d["anchor_age"] * 365 + whole("day", 0, 364).cast("int"), whole("hour", 0, 23).cast("int"), whole("minute", 0, 59).cast("int"), whole("second", 0, 59).cast("decimal(18,6)"))
    code = F.lpad(whole("zip", 10000, 99999).cast("string"), 5, "0")
    number = whole("phone", 0, 9999999)
    return n.select(
        "subject_id", name.alias("name"), whole("unit", 1, 10**9).alias("unit_no"),
        F.concat_ws(" ", F.element_at(F.array(*map(F.lit, first)), (F.pmod(doctor, F.lit(len(first))) + 1).cast("int")), F.element_at(F.array(*map(F.lit, last)), (F.pmod(F.floor(doctor / len(first)), F.lit(len(last))) + 1).cast("int"))).alias("physician_name"),
        simplify_race(d["race"]).alias("race"), simplify_language(d["language"]).alias("language"), born.alias("dob"),
        F.concat(F.replace(F.lower(name), F.lit(" "), F.lit(".")), whole("mail", 1, 1000).cast("string"), F.lit("@"), pick(domains, "domain")).alias("email"),
        F.format_string("(%s) %03d-%04d", F.substring(code, 1, 3), F.floor(number / 10000), F.pmod(number, F.lit(10000))).alias("phone"),
        F.format_string("%03d-%02d-%04d", whole("ssn1", 900, 999), whole("ssn2", 1, 99), whole("ssn3", 1, 9999)).alias("ssn"),
        F.concat(whole("house", 1, 9999).cast("string"), F.lit(" "), pick(streets, "street"), F.lit(", ZU "), code).alias("address"),
        F.when(s == F.lit(shared_member), False).otherwise(canary).alias("random_name"),
    )


#: A key, a colon and a value: each in quotes of either kind, or bare up to the next comma, bracket or line's end.
_PAIR = r"""["'“”]?(\w[\w\-]*)["'“”]?\s*[:=]\s*["'“”]?([^"'“”,{}\n]*)"""


def repaired_object(text: Column) -> Column:
    """Map of one JSON object, or of what can be read of a broken one: trailing or missing commas, quotes missing or of the wrong kind, a missing last bracket, comments. Of a repeated key the last value holds."""
    whole = F.from_json(text, "map<string,string>")
    bare = F.regexp_replace(text, r"(?m)(^|[\s,])(//|#).*$", "$1")
    pairs = F.arrays_zip(F.regexp_extract_all(bare, F.lit(_PAIR), 1).alias("k"), F.regexp_extract_all(bare, F.lit(_PAIR), 2).alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"]
    return F.coalesce(whole, F.map_from_arrays(keys, F.transform(keys, last)))


def parse_categories(reply: Column, n: Column) -> Column:
    """Map from blank number to category out of a classifier's reply.

    The reasoning block goes; the last ```json fence counts, else the second
    fence, else the whole text; several objects are merged, later ones win;
    what is missing or unknown becomes ``other``. Objects that are no valid
    JSON are repaired (``repaired_object``). NULL and empty replies give
    ``other`` for every blank.
    """
    text = F.coalesce(reply, F.lit(""))
    parts = F.split(text, "```")
    json_fences = F.split(text, "```json", -1)
    fenced = F.when(F.size(json_fences) > 1, F.element_at(F.split(F.element_at(json_fences, -1), "```"), 1)).when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise("")
    objects = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?s)(\{[^{}]*(?:\}|$))"), 1), repaired_object), lambda m: F.size(m) > 0)
    found = F.when(F.size(objects(fenced)) > 0, objects(fenced)).otherwise(objects(F.regexp_replace(text, r"(?is)<think>.*?</think>", "")))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k.cast("string"))
    value = lambda k: F.lower(F.trim(F.try_element_at(F.filter(F.transform(found, lambda m: F.try_element_at(m, k)), lambda v: v.isNotNull()), F.lit(-1))))
    known = lambda v: F.when(v.isin(*D.CATEGORIES), v).otherwise("other")
    whole = F.map_from_arrays(keys, F.transform(keys, lambda k: known(value(k))))
    return F.when(n >= 1, whole).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def response_text(content: Column, reasoning_content: Column, reasoning: Column) -> Column:
    """The first of the three that holds more than blanks, without the reasoning block."""
    clean = lambda c: F.nullif(X.strip_think(c), F.lit(""))
    return F.coalesce(clean(content), clean(reasoning_content), clean(reasoning), F.lit(""))


def instruction_text(instruction: Column, given: Column, output: Column) -> Column:
    """The training text of a record; labels start at the response."""
    # The headings of the training text.
    head = F.concat(F.lit("### Instruction:\n"), instruction)
    head = F.when(F.coalesce(given, F.lit("")) != "", F.concat(head, F.lit("\n\n### Input:\n"), given)).otherwise(head)
    return F.concat(head, F.lit("\n\n### Response:\n"), output)
