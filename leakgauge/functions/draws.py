"""Deterministic draws and hash arithmetic: every random choice is a function of a salt and a key.

The same row gets the same draw whatever the partitions, the order or the
number of executors, and after a task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(salt: str, *keys: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5; NULL keys count as empty."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def sql_draw(salt: str, *keys: str) -> str:
    parts = "||'|'||".join([f"'{salt}'"] + [f"coalesce({k}::VARCHAR, '')" for k in keys])
    return f"(('0x'||substr(md5({parts}),1,8))::BIGINT::DOUBLE/4294967296.0)"


def stable_int(value: Column, salt: str = "") -> Column:
    """The first 48 bits of the sha256 of ``salt::value`` as a LONG."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}::"), value.cast("string")), 256), 1, 12), 16, 10).cast("long")


def sql_stable_int(value: str, salt: str = "") -> str:
    return f"(('0x'||substr(sha256('{salt}::'||{value}),1,12))::BIGINT)"


def demographics(subject: Column) -> dict[str, Column]:
    """Age, gender, race, language, anchor year and admission time of a subject."""
    r = stable_int(subject, "demo")
    at = lambda shift, n: F.pmod(F.shiftright(r, shift), F.lit(n))
    year = F.pmod(r, F.lit(30)) + 2110
    return {
        "anchor_age": (F.pmod(r, F.lit(73)) + 18).cast("int"),
        "gender": F.element_at(F.array(F.lit("M"), F.lit("F")), (at(3, 2) + 1).cast("int")),
        "race": F.element_at(F.array(*map(F.lit, ("white", "black", "hispanic", "asian"))), (at(5, 4) + 1).cast("int")),
        "language": F.lit("English"),
        "anchor_year": year.cast("int"),
        "admittime": F.format_string("%d-%02d-%02d 12:00:00", year, at(7, 12) + 1, at(11, 28) + 1),
    }
