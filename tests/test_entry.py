"""The driver's entry points."""

import ast
import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    import __spark_entry__ as entry

    named, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(named) and len(named) > 60


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "marginalia").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    names = [x.name for x in node.names] + [getattr(node, "module", None) or ""]
                    assert not any(re.search(r"\bllm\b|corpus_pipeline", n) for n in names), path
