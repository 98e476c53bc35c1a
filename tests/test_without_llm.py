"""The rest works when the training-data part is gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_and_names(tmp_path):
    new = tmp_path / "repo"
    shutil.copytree(ROOT, new, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'peak_events' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=new, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_other_tests_pass(tmp_path):
    """Those of the queries' names and of the k-means query's candidates stand for the rest here: the whole takes its time."""
    new = tmp_path / "repo"
    shutil.copytree(ROOT, new, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse"))
    which = ["tests/test_kmeans_query.py::test_candidates_and_rounds", "tests/test_queries.py::test_names"]
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *which], cwd=new, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.returncode == 0, out.stdout[-2000:]


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidemark")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "tidemark.llm" not in open(os.path.join(folder, n)).read(), n
