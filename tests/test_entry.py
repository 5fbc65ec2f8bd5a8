from __future__ import annotations

import importlib
from pathlib import Path

import pytest

SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__file__).resolve().parent.parent / "loomline"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "loomline.llm" not in file.read_text(), file


@pytest.mark.skipif(not SMALL.exists(), reason="no tables")
def test_flagship(spark, rows):
    entry = importlib.import_module("__spark_entry__")
    assert [r[0] for r in rows(entry.entry(spark))] == ["A", "N", "R"]
