"""The registry, and that it stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry_has_an_oracle_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "concord"):
        src, to = os.path.join(ROOT, name), tmp_path / name
        shutil.copytree(src, to, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, to)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mknn_views' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_flagship_value(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert (row.encoder_a, row.encoder_b) == ("va", "vb") and row.mknn == pytest.approx(0.2742, abs=1e-4)
