"""Registry of the core queries and their DuckDB statements."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Queries that tell apart the deliveries of a note by their time.
STAMPED = frozenset(
    "X1_blank_offsets X2_numbered_blanks X8_parse_line T5_subject_split T6_subject_sample R1_first_blank R5_mock_classifier C4_X3_T8_injected_notes C39_instruction_text J2_without_persona J4_personas_back_onto_notes T1_T3_largest_smallest".split()
)

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text_queries", "prepare_queries", "curve_queries", "metric_queries", "risk_queries", "table_queries", "report_queries", "source_queries")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its operator's name, with its DuckDB statement where SQL can express it.

    A ``storetime`` in a compared result leaves both engines as microseconds,
    so that no time zone or rendering of timestamps comes between them.
    """

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = query
        if sql and name in STAMPED:
            _QUERIES[name] = lambda spark, d: query(spark, d).withColumn("storetime", F.unix_micros("storetime"))
            _SQL[name] = f"SELECT * REPLACE (epoch_us(storetime) AS storetime) FROM ({sql})"
        elif sql:
            _SQL[name] = sql
        return query

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"leakgauge.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["C15_curves"](spark, sf_dir)
