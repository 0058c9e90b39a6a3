import importlib.util
import os
import subprocess
import sys

import pytest

from pathloom import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", core.queries())
def test_query_equals_its_sql(name, same_rows):
    same_rows(core.queries()[name], core.oracle_sql()[name])


def test_entry(spark, sf, monkeypatch):
    monkeypatch.setenv("ENTRY_SF_DIR", sf)
    spec = importlib.util.spec_from_file_location("entry_module", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(core.queries()) <= set(module.queries())


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when the text subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(f"{ROOT}/pathloom", tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 20; print('ok')"
    env = {**os.environ, "PYTHONPATH": ""}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120).stdout.strip() == "ok"
