import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

LIST = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"


def listed(place):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=place, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(place)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [line.split() for line in out.stdout.splitlines()]


@pytest.mark.parametrize("gone", [("histlab/llm", "tests/llm", "corpus_pipeline.py"), ("histlab/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_parts_can_be_deleted(tmp_path, gone):
    place = tmp_path / "copy"
    shutil.copytree(ROOT, place, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        target = place / name
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    names, oracles = listed(place)
    assert "pipeline" not in names and set(oracles) <= set(names) and "domain_topk" in names
    if "histlab/llm" in gone:
        assert not any(n.startswith("op") for n in names)
