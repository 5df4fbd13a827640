import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_catalogue_needs_no_files_of_spark():
    """Names and SQL are there without any of Spark's jars, and without a session."""
    code = (
        "import zipfile, pathlib, glob\n"
        "def gone(*a, **k): raise FileNotFoundError('no jars')\n"
        "zipfile.ZipFile = pathlib.Path.glob = glob.glob = gone\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and len(e.oracle_sql()) > 40\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_core_does_not_need_the_llm_subpackage():
    root = Path(entry.__file__).parent / "docketlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "docketlake.llm" not in path.read_text(), path


def test_problem_queries_come_in_order():
    if not importlib.util.find_spec("docketlake.llm"):
        pytest.skip("without the llm subpackage")
    names = list(entry.queries())
    for n in (1, 2, 3, 4, 5, 6, 8, 9):
        assert f"p{n}_found" in names


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
