"""The library without its subpackage for training data."""

import os
import shutil
import subprocess
import sys


def test_entry_loads_without_the_subpackage(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/flowloom", tmp_path / "flowloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{top}/{name}"):
            shutil.copy(f"{top}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert said.stdout.strip() == "fine", said.stderr
