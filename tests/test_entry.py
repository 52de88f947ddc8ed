"""The entry without the training-data part, whole or in remains."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left", ["nothing", "caches", "no automaton"])
def test_core_queries_remain(tmp_path, left):
    for name in ("tidemark", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    part = tmp_path / "tidemark" / "llm"
    if left == "no automaton":
        if part.exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        (tmp_path / "ahocorasick.py").write_text("raise ImportError('not installed')")
    elif part.exists():
        shutil.rmtree(part)
        if left == "caches":
            (part / "__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), e.WITHOUT_LLM)"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 80 and said.stdout.split()[1] == "False"
