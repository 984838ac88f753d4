"""The driver's contract and the independence of the core."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 41 and df.columns[0] == "budget"


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_names_the_optional_subpackage():
    for p in (ROOT / "leakgauge").rglob("*.py"):
        if "llm" not in p.parts:
            code = [line for line in p.read_text().splitlines() if line.lstrip().startswith(("import ", "from "))]
            assert not any("leakgauge.llm" in line for line in code), p


def test_core_queries_match_duckdb():
    names = ["C15", "F1_", "X4", "A17_auc", "U2", "C4_X3", "A7"]
    out = subprocess.run([sys.executable, str(ROOT / "tools/compare.py"), SF, *names], capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stdout
