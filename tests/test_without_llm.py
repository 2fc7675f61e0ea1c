"""The core imports and runs without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_core_alone(tmp_path, sf):
    repo = Path(__file__).resolve().parent.parent
    (tmp_path / "shelfwise").mkdir()
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    shutil.copytree(repo / "shelfwise", tmp_path / "shelfwise", dirs_exist_ok=True, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = f"""
import __spark_entry__ as e
from shelfwise.session import local_session
names = e.queries()
assert names and not [k for k in names if k.startswith("op") and k[2].isdigit()] and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
print(names["catalog_summary"](local_session(2, 2, "1g"), {sf!r}).count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 0, out.stderr[-2000:]
