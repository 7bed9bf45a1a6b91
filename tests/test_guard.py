"""The rest imports and registers its queries where the training-data part is missing."""

import sys

import __spark_entry__ as entry
from papertide.plans import catalogue


def test_entry_without_llm(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("papertide.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "papertide.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr("papertide.llm", raising=False)
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())
