"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_works_from_another_folder(tmp_path):
    """Workers get the package from the driver, not from the working folder."""
    code = f"import sys; sys.path.insert(0, {str(REPO)!r}); import __spark_entry__ as e; from lodegraph.session import local_session; s = local_session(2, 2); assert e.entry(s).count() >= 0; assert e.queries()['extract_stats'](s, '/root/testdata/sf0.001').count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, capture_output=True)


def test_nothing_imports_the_llm_package():
    for p in (REPO / "lodegraph").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p
