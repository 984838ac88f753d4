"""Registry of direct-identifier types and the label classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.functions import text as X

#: Characters before a blank in which its label is looked for.
WINDOW = 40


@dataclass(frozen=True)
class DIType:
    name: str
    category: str
    persona_field: str
    parser: str
    max_new_tokens: int
    prompts: tuple[str, ...]
    labels: tuple[str, ...]


# Labels, categories, fields, prompts and lengths of the six identifier types.
DI_TYPES = (
    DIType("name", "name-patient", "name", "first_two_words", 20, ("Name: ", "Patient: "), ("Name:",)),
    DIType("attending", "name-attending", "physician_name", "first_two_words", 20, ("Attending: ", "Dr. "), ("Attending:",)),
    DIType("mrn", "id", "unit_no", "digits", 12, ("MRN: ", "Unit No: "), ("MRN:", "Unit No:")),
    DIType("address", "address", "address", "line", 40, ("Address: ",), ("Address:", "Mailing Address:", "Address on file:")),
    DIType("phone", "phone", "phone", "line", 12, ("Phone: ",), ("Phone:",)),
    DIType("email", "email", "email", "word", 16, ("Email: ",), ("Email:",)),
)
CATEGORIES = tuple(sorted({d.category for d in DI_TYPES})) + ("date", "other")


def get(name: str) -> DIType:
    for d in DI_TYPES:
        if d.name == name:
            return d
    raise KeyError(f"unknown identifier type {name!r}; known: {sorted(d.name for d in DI_TYPES)}")


def registry(spark: SparkSession) -> DataFrame:
    rows = [(d.name, d.category, d.persona_field, d.parser, d.max_new_tokens, list(d.prompts), list(d.labels)) for d in DI_TYPES]
    return spark.createDataFrame(rows, "name string, category string, persona_field string, parser string, max_new_tokens int, prompts array<string>, labels array<string>")


def detect(prefix: Column, default: str = "name") -> Column:
    """Category of the label nearest before a blank; the first type wins ties, ``default`` where no label stands."""
    tail = F.lower(F.right(prefix, F.lit(WINDOW)))
    found = [F.struct(X.rfind(tail, label.lower()).alias("at"), F.lit(-k).alias("order"), F.lit(d.category).alias("category")) for k, d in enumerate(DI_TYPES) for label in d.labels]
    best = F.array_max(F.array(*found))
    return F.when(best["at"] >= 0, best["category"]).otherwise(get(default).category)


def sql_detect(prefix: str, default: str = "name-patient") -> str:
    """The same as a DuckDB expression."""
    tail = f"lower(right({prefix}, {WINDOW}))"
    rows = ", ".join(f"{{'at': CASE WHEN contains({tail}, '{x.lower()}') THEN length({tail}) - instr(reverse({tail}), '{x.lower()[::-1]}') - {len(x)} + 1 ELSE -1 END, 'o': {-k}, 'c': '{d.category}'}}" for k, d in enumerate(DI_TYPES) for x in d.labels)
    return f"(CASE WHEN list_max([{rows}]).at >= 0 THEN list_max([{rows}]).c ELSE '{default}' END)"


def persona_value(category: Column) -> Column:
    """R2: the persona's value for a category as text, NULL for one without a field."""
    out = F.lit(None).cast("string")
    for d in DI_TYPES:
        out = F.when(category == d.category, F.col(d.persona_field).cast("string")).otherwise(out)
    return out
