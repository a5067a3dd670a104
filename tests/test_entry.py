import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_flagship_query_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("without", [(), ("glossa/llm", "corpus_pipeline.py")])
def test_the_entry_imports_without_a_session_and_without_the_subpackage(tmp_path, without):
    for name in ("glossa", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name)
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in without:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[0]) > 130 and out.stdout.split()[1] == "0"
