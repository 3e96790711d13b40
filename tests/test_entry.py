"""The driver's contract, and that the corpus operators are an optional part."""

import os
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["template_id", "uses", "first_line"] and df.count() > 0


def test_every_oracle_has_a_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


def test_imports_without_the_corpus_operators(tmp_path):
    for name in ("logloom", "__spark_entry__.py"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "logloom").mkdir()
    for name in os.listdir(f"{ROOT}/logloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/logloom/{name}", tmp_path / "logloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_match' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{ROOT}/logloom"):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, name)) as f:
                    assert "logloom.llm" not in f.read(), name
