import importlib
import sys

import pytest

import __spark_entry__
from tests.compare import assert_same
from verbascope.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, oracle, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLES:
        assert_same(df, oracle, catalog.ORACLES[name])
    else:
        assert df.columns and df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).collect()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    for name in [x for x in sys.modules if x.startswith("verbascope.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "verbascope.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) == set(catalog.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
