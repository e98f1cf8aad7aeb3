import importlib
import subprocess
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def test_library_never_imports_the_training_data_subpackage():
    code = "import sys, __spark_entry__ as e, pkgutil, codeloom; from codeloom.plans import registry; registry.queries(); import codeloom.api; print([m for m in sys.modules if m.startswith('codeloom.llm')])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry._HERE, check=True)
    assert out.stdout.strip() == "[]"


def test_modules_have_names():
    from codeloom.plans import registry

    for m in registry.MODULES:
        module = importlib.import_module(f"codeloom.plans.{m}")
        assert set(module.ORACLE) <= set(module.QUERIES)
