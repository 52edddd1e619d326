"""The driver's contract, also where the training-data operators are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__spark_entry__.__file__).resolve().parent


def test_names():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert "throughput_by_model" in found
    if __spark_entry__.HAS_LLM:
        assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
        assert "pipeline" in found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op1') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_without_a_library_of_the_subpackage(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert not e.HAS_LLM and e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_only_the_entry_imports_the_subpackage():
    for path in (REPO / "gaugeworks").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "gaugeworks.llm" not in path.read_text(), path
