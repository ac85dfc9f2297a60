"""Each registered query against its SQL, and the package's boundaries."""

from __future__ import annotations

import ast
import re
from pathlib import Path

import pytest

from larkspan.plans import catalogue
from tests.compare import by_duckdb, by_spark

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    got = by_spark(catalogue.QUERIES[name](spark, small))
    if name in catalogue.ORACLE_SQL:
        assert got == by_duckdb(catalogue.ORACLE_SQL[name], small)
    else:
        assert got[1]


def test_every_sql_has_its_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "larkspan").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "larkspan").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(re.match(r"larkspan[.]llm|corpus_pipeline", n) for n in names), p


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["stream_id", "false_accepts"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    from larkspan.operators import metrics
    from larkspan.plans import views

    plan = metrics.false_negatives(views.scores(spark, small), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
