import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_the_flagship_query_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["gene", "sample", "q", "value"] and found.count() > 0


def test_every_mirror_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_imports_without_the_text_operators():
    code = "import sys; sys.modules['varietas.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
