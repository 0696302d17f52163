"""The driver entry with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def copied(to: Path, *left_out: str) -> Path:
    ignore = shutil.ignore_patterns("__pycache__", ".git", "tests", *left_out)
    shutil.copytree(ROOT, to, ignore=ignore)
    return to


def imported(folder: Path) -> str:
    return subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout


def test_entry_without_the_subpackage(tmp_path):
    assert imported(copied(tmp_path / "a", "llm", "corpus_pipeline.py")) == imported(copied(tmp_path / "b", "llm")) != ""


def test_entry_raises_other_import_errors(tmp_path):
    folder = copied(tmp_path / "c")
    if (folder / "quillspark/llm").exists():
        (folder / "quillspark/llm/queries.py").write_text("import no_such_module\n")
        done = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=folder, capture_output=True, text=True, check=False)
        assert done.returncode and "no_such_module" in done.stderr
