"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = str(Path(__file__).resolve().parent.parent)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_the_rest_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['bandweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for path in Path(REPO, "bandweave").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "llm" not in path.read_text(), path
