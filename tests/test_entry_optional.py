"""The entry module works without the optional training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_part(tmp_dir):
    copy = os.path.join(tmp_dir, "repo")
    os.makedirs(copy)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    shutil.copytree(os.path.join(ROOT, "incidentlab"), os.path.join(copy, "incidentlab"),
                    ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'enriched' in q and 'pipeline' not in q; " \
           "assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                          env={**os.environ, "PYTHONPATH": copy})
    assert done.returncode == 0, done.stderr
