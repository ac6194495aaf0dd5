"""The registry is whole or an error."""

import importlib
import importlib.util
import sys

import pytest

import __spark_entry__


@pytest.mark.skipif(importlib.util.find_spec("sagaweave.llm") is None, reason="the subpackage is not installed")
def test_failing_import_is_an_error(monkeypatch):
    name = "sagaweave.llm.queries"
    monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    from sagaweave import runtime

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_cuts_are_cleared(spark):
    from pathlib import Path

    from sagaweave import runtime

    scratch = runtime.Scratch(spark, "t")
    one, seen = scratch.counted(spark.range(5))
    assert seen["n"] == 5
    two = scratch.cut(one, replaces=one)
    assert two.count() == 5
    base = Path(scratch.base.removeprefix("file://"))
    assert len(list(base.iterdir())) == 1
    runtime.clear(spark)
    assert not base.exists()
