import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "changed_pixels" in df.columns


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_imports_without_the_optional_subpackage(tmp_path):
    import shutil

    shutil.copytree(REPO / "stillwater", tmp_path / "stillwater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
