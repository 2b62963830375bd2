import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["n"]


def _names(folder, before=""):
    code = f"{before}\nimport __spark_entry__ as e; print(' '.join(sorted(e.queries())))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=False)


def test_without_the_preparation_package(tmp_path):
    here = Path(__file__).resolve().parents[1]
    for name in ("graphloom", "__spark_entry__.py"):
        (shutil.copytree if (here / name).is_dir() else shutil.copy)(here / name, tmp_path / name)
    shutil.rmtree(tmp_path / "graphloom" / "llm", ignore_errors=True)
    names = _names(tmp_path).stdout.split()
    assert "count_triangle_none" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    if (here / "corpus_pipeline.py").exists():
        shutil.copy(here / "corpus_pipeline.py", tmp_path)
        assert _names(tmp_path).stdout.split() == names
        # a library that is missing is told
        found = _names(here, "import sys; sys.modules['numpy'] = None")
        assert found.returncode and "numpy" in found.stderr
