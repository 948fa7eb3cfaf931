"""The entry without the folders that may be deleted, and with one that can't be imported."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) >= len(e.oracle_sql()) > 40)"


def said(folder, ask=ASK):
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p != ROOT)}
    return subprocess.run([sys.executable, "-B", "-c", ask], cwd=folder, env=env, capture_output=True, text=True)


def test_without_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quire"), tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert said(tmp_path).stdout.strip().endswith("[] True")


def test_other_errors_show(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quire"), tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "quire" / "llm").mkdir()
    (tmp_path / "quire" / "llm" / "__init__.py").write_text("")
    (tmp_path / "quire" / "llm" / "queries.py").write_text("import no_such_module_here\n")
    assert "no_such_module_here" in said(tmp_path).stderr
