"""The whole API on the smallest tables, down to JSON."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import DataFrame

from tokenledger.api import Ledger, json_lines
from tokenledger.workload.projections import AS_OF, event_tables

QUESTIONS = [
    "overview", "daily", "top", "efficiency", "governance", "behaviour", "targets", "sessions", "anomalies",
    "quality", "model_daily", "hourly", "burndown", "baseline", "periods", "trend", "cohort",
]
MAY_BE_EMPTY = {"anomalies"}


@pytest.mark.parametrize("question", QUESTIONS)
def test_answers_are_json(spark, question):
    ledger = Ledger(event_tables(spark, "/root/testdata/sf0.001"), AS_OF)
    answer = getattr(ledger, question)()
    parts = {question: answer} if isinstance(answer, DataFrame) else answer
    for name, part in parts.items():
        rows = [json.loads(r["json"]) for r in json_lines(part).collect()]
        assert rows or name in MAY_BE_EMPTY
        assert all(set(row) == set(part.columns) for row in rows)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tokenledger.llm", "tokenledger.llm.registry", "zstandard", "xxhash"])
def test_the_entry_works_without_the_operators(missing):
    """In a fresh process in which one of the modules cannot be imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n[:2] == 'op'))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split(" ", 1)
    assert int(out[0]) > 100
    if missing.startswith("tokenledger"):
        assert out[1].strip() == "[]"
