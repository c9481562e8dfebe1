import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['noetia.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'p6_found' in q and 'p1_found' not in q, q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "noetia").rglob("*.py"):
        if "llm" not in p.parts:
            assert "noetia.llm" not in p.read_text(), p
