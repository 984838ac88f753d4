"""Canonical forms of identifiers, shared by problems 4 and 6, all in built-in expressions.

* numbers (``unit_no``, ``phone``): the digits alone;
* e-mail addresses: letters and digits, lower case;
* names, addresses and everything else: the lower-case words in byte order.

A value with no letter or digit left, a NULL and a value in square brackets
have no form (NULL). Without a type the kind is read off the value: an ``@``
makes an e-mail address, no letter at all a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types whose digits alone count, and the type of e-mail addresses.
NUMBER_TYPES = ("unit_no", "phone")
EMAIL_TYPES = ("email",)
WORD_PATTERN = r"[\p{L}\p{M}\p{Nd}]+"
BRACKETED = r"(?s)^\s*\[.*\]\s*$"


def kind_of(value: Column, pii_type: Column | None = None) -> Column:
    """``number``, ``email`` or ``words``."""
    by_form = F.when(F.instr(value, "@") > 0, "email").when(~value.rlike(r"\p{L}"), "number").otherwise("words")
    if pii_type is None:
        return by_form
    return F.when(pii_type.isNull(), by_form).when(pii_type.isin(*NUMBER_TYPES), "number").when(pii_type.isin(*EMAIL_TYPES), "email").otherwise("words")


def with_form(df: DataFrame, value: Column, kind: Column, out: str) -> DataFrame:
    """The rows with a canonical form, in the column ``out``. As a generator it is evaluated once, also where rows are filtered by it."""
    words = F.array_join(F.sort_array(F.regexp_extract_all(F.lower(value), F.lit(WORD_PATTERN), 0)), " ")
    form = F.when(kind == "number", F.regexp_replace(value, r"\P{Nd}", "")).when(kind == "email", F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{Nd}]", "")).otherwise(words)
    form = F.when(value.isNull() | value.rlike(BRACKETED), None).otherwise(form)
    return df.select("*", F.explode(F.filter(F.array(form), lambda x: x != "")).alias(out))


def sql_form(value: str, pii_type: str | None = None) -> str:
    """The same form as a DuckDB expression, for the oracle."""
    by_form = f"CASE WHEN contains({value}, '@') THEN 'email' WHEN NOT regexp_matches({value}, '\\p{{L}}') THEN 'number' ELSE 'words' END"
    kind = by_form if pii_type is None else f"CASE WHEN {pii_type} IS NULL THEN {by_form} WHEN {pii_type} IN ('unit_no','phone') THEN 'number' WHEN {pii_type} = 'email' THEN 'email' ELSE 'words' END"
    return (
        f"CASE WHEN {value} IS NULL OR regexp_matches({value}, '^\\s*\\[.*\\]\\s*$', 's') THEN NULL ELSE nullif(CASE {kind} WHEN 'number' THEN regexp_replace({value}, '\\P{{Nd}}', '', 'g') "
        f"WHEN 'email' THEN regexp_replace(lower({value}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]', '', 'g') "
        f"ELSE array_to_string(list_sort(regexp_extract_all(lower({value}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+')), ' ') END, '') END"
    )
