from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import sys

from conftest import ROOT


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_returns_rows(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert df.columns[:2] == ["date", "revenue"]
    assert df.count() > 0


def test_contract_maps():
    mod = _entry_module()
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 80


def test_imports_without_the_training_data_operators(tmp_path):
    """The library, its entry and every report key stand without mercata/llm and the pipeline."""
    skip = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(ROOT, "mercata"), tmp_path / "mercata", ignore=skip)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 80 and set(e.oracle_sql()) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    # the pipeline alone, without the subpackage it calls, is no reason to fail either
    pipeline = os.path.join(ROOT, "corpus_pipeline.py")
    if os.path.exists(pipeline):
        shutil.copy(pipeline, tmp_path / "corpus_pipeline.py")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
