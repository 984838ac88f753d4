"""Sources (S1 to S14): files by format, globs with parsed names, configuration and synthetic tables."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions.draws import draw

try:
    import yaml
except ImportError:
    yaml = None

# Patterns of run names in file names and folders.
PROBABILITY_FILE = r"overall_proba_([^_/]+)_([^_/]+)_(\d+)\.csv"
CURVE_FILE = r"theoretical_curves_tau_([\d.]+)\.csv"
RUN_FOLDER = r"([^/_]+)_([^/_]+)_([\d.]+)_(\d+)_([^/_]+)"


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Header, quoted line breaks of any kind; with ``columns`` the parser only builds those. An empty field is NULL, ``""`` an empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("lineSep", "\n").option("nullValue", None).option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_per_note(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one JSON file per note; note_id is the file's name."""
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("note_id"))


def any_format(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by the suffix, JSON by .json, else CSV."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    return spark.read.parquet(path) if suffix == ".parquet" else json_array(spark, path) if suffix == ".json" else csv(spark, path)


def glob(spark: SparkSession, pattern: str, fmt: str = "csv", **options: object) -> DataFrame:
    """All files of a pattern with their file_path."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    df = reader.options(**options).load(pattern)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def run_columns(path: Column) -> dict[str, Column]:
    """Dataset, model, rate, epochs and seed of a run folder; NULL where the name does not fit."""
    part = lambda k: F.nullif(F.regexp_extract(path, RUN_FOLDER, k), F.lit(""))
    return {"dataset": part(1), "model": part(2), "pii_rate": part(3).try_cast("double"), "n_epochs": part(4).try_cast("int"), "k": part(5)}


def tau_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, CURVE_FILE, 1), F.lit("")).try_cast("double")


def config(text: str, **values: object) -> dict:
    """A YAML or JSON configuration whose string values are templates like ``{model}``.

    JSON needs nothing; YAML needs the ``yaml`` module, an error says so where it is missing. An empty text is an empty map.
    """
    fill = lambda v: v.format(**values) if isinstance(v, str) else {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else [fill(x) for x in v] if isinstance(v, list) else v
    try:
        return fill(json.loads(text))
    except json.JSONDecodeError:
        if yaml is None:
            raise ImportError("a configuration in YAML needs the yaml module; JSON needs none") from None
        return fill(yaml.safe_load(text) or {})


COMPLAINTS = ("cough", "fever", "fatigue", "back pain", "rash", "headache", "nausea", "swelling", "palpitations", "dizziness", "sore throat", "cramps")
SERVICES = ("medicine", "surgery", "cardiology", "neurology", "oncology", "orthopedics", "psychiatry")
MASKED = (
    "Name: ___  Unit No: ___\nService: %s\nChief complaint: %s\nAttending: ___\n",
    "MRN: ___\nName: ___\nSeen in %s for %s.\nAttending: ___. Phone: ___.\n",
    "Name: ___\nMRN: ___\nAttending: ___\n\nReferred to %s with %s. Address on file: ___.\n",
)


def _pick(words: tuple[str, ...], salt: str, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(draw(salt, *keys) * len(words)) + 1).cast("int"))


def synthetic_notes(spark: SparkSession, n_subjects: int, max_notes: int, seed: int = 42) -> DataFrame:
    """subject_id and masked note; every choice is a hash draw, so any number of subjects is made in parallel."""
    s, k = F.col("id"), F.col("k")
    n = spark.range(n_subjects).select("id", F.explode(F.sequence(F.lit(1), (F.floor(draw(f"n{seed}", s) * max_notes) + 1).cast("int"))).alias("k"))
    service, complaint = _pick(SERVICES, f"service{seed}", s, k), _pick(COMPLAINTS, f"complaint{seed}", s, k)
    kind = F.floor(draw(f"template{seed}", s, k) * len(MASKED))
    note = F.when(kind == 0, F.format_string(MASKED[0], service, complaint)).when(kind == 1, F.format_string(MASKED[1], service, complaint)).otherwise(F.format_string(MASKED[2], service, complaint))
    return n.select(F.format_string("P%08d", s).alias("subject_id"), note.alias("note"))


def synthetic_identified(spark: SparkSession, n_subjects: int, max_notes: int, first: list[str], last: list[str], val_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Notes with the identifiers in place (with split) and the labelled entries: training names 1, other names 0."""
    from leakgauge.plans.prepare import split_by_subject

    notes = split_by_subject(synthetic_notes(spark, n_subjects, max_notes, seed), val_share, seed)
    s = F.col("subject_id")
    name = F.concat_ws(" ", _pick(tuple(first), f"first{seed}", s), F.concat(_pick(tuple(last), f"last{seed}", s), F.lower(F.substring(F.translate(F.md5(s), "0123456789", "ghijklmnop"), 1, 6))))
    filled = notes.withColumn("name", name).withColumn("note", F.regexp_replace("note", r"Name: ___", F.concat(F.lit("Name: "), F.col("name"))))
    people = filled.select("name", "split").distinct()
    members = people.filter("split = 'train'").select(F.col("name").alias("entry")).distinct()
    others = people.filter("split = 'val'").select(F.col("name").alias("entry")).distinct().join(members, "entry", "left_anti")
    return filled, members.withColumn("label", F.lit(1)).unionByName(others.withColumn("label", F.lit(0)))


def gazetteer(names: DataFrame, column: str) -> DataFrame:
    """Folded distinct first names (``w``) of a table of names, of any locale."""
    from leakgauge.functions.text import letters_only

    return names.filter(F.col(column).isNotNull()).select(F.lower(letters_only(F.element_at(F.split(F.trim(column), r"\s+"), 1))).alias("w")).filter("w <> ''").distinct()


def demographics_join(notes: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Notes with their admission and patient; clashing columns of the right sides get a suffix."""
    for right, key, suffix in ((admissions, "hadm_id", "_admission"), (patients, "subject_id", "_patient")):
        for c in [c for c in right.columns if c in notes.columns and c != key]:
            right = right.withColumnRenamed(c, c + suffix)
        notes = notes.join(right, key)
    return notes
