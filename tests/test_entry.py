"""The entry module without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 50 and set(e.oracle_sql()) <= set(names)
assert not any(n.startswith("op") for n in names) and "pipeline" not in names
"""


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/sparrowlog", tmp_path / "sparrowlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
