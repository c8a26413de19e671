"""The driver's entry, whole and with its optional folders gone."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_optional_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    (tmp_path / "repo/tessera/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert q and set(e.oracle_sql()) == set(q) - {'goal_generations'} and not any(n.startswith('op') and n[2].isdigit() for n in q), q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)


def test_flagship_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
