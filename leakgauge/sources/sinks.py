"""Sinks (K1 to K6, K9, K11 to K14). Big tables are written by the tasks; only reports of a few rows reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.text import python_str_list

#: A report that is written by the driver may hold so many rows.
REPORT_ROWS = 10_000


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] = (), rows_per_file: int = 0) -> None:
    """K1, K5: one file per task and partition value, rows flushed by the task's writer; ``rows_per_file`` at most to a file."""
    w = df.write.mode(mode)
    w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2, K6: header; arrays are written the way a list prints. ``mode='ignore'`` keeps what is there."""
    flat = df.select(*[python_str_list(F.col(f"`{c}`")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
    flat.write.mode(mode).option("header", True).option("escape", '"').option("lineSep", "\n").option("nullValue", None).option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite", per_file: int = 0) -> None:
    """K3: one record per line, non-ASCII kept; ``per_file`` records to a file at most."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.option("maxRecordsPerFile", per_file) if per_file else w).json(path)


def json_report(df: DataFrame, path: str | None = None) -> str:
    """The rows of a small report as one indented JSON array; more than REPORT_ROWS rows are an error."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows is a table; use parquet or json_lines")
    text = json.dumps([r.asDict(recursive=True) for r in rows], indent=2, ensure_ascii=False, default=str)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def ranked_errors(scores: DataFrame, tau: float, score: str, y: str, false_positives: bool) -> DataFrame:
    """False positives by falling score, or false negatives by rising score; a range-partitioned sort."""
    if false_positives:
        return scores.filter((F.col(y) == 0) & (F.col(score) >= tau)).orderBy(F.desc(score))
    return scores.filter((F.col(y) == 1) & (F.col(score) < tau)).orderBy(F.asc(score))


def cached(make, spark, path: str, refresh: bool = False) -> DataFrame:
    """The Parquet at ``path`` if it is there, else ``make()`` written to it."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only a missing path means there is no cache
            if "PATH_NOT_FOUND" not in str(e):
                raise
    parquet(make(), path)
    return spark.read.parquet(path)
