"""The queries are registered; those with SQL equal it."""

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from llm_cases import SF

from codeaudit.llm.queries import LLM_ORACLE, LLM_QUERIES

ROOT = Path(__file__).resolve().parents[2]


def test_names_and_no_import_from_outside():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES) == list(range(1, 14))
    for p in (ROOT / "codeaudit").rglob("*.py"):
        if "llm" not in p.parts:
            assert "codeaudit.llm" not in p.read_text()
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=ROOT,
                          capture_output=True, text=True, timeout=120).stdout.split()
    assert {"pipeline", *LLM_QUERIES} <= set(told)


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(LLM_ORACLE[name])
    names, want = [d[0] for d in got.description], Counter(got.fetchall())
    df = LLM_QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want
