import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_registered_names():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len([q for q in queries if not q.startswith("op") and q != "pipeline"]) >= 45
    assert all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "type", "name", "label"]
    assert 0 < entry.entry(spark).count() <= 20


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
