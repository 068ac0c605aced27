"""The other queries are there when the training-data operators can't be imported."""

import importlib
import sys

import pytest


@pytest.mark.parametrize("missing", ["halyard.llm", "public_tokenizers", "corpus_pipeline"])
def test_queries_without(monkeypatch, missing):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("halyard.llm") or m == missing]:
        monkeypatch.delitem(sys.modules, name)
    if "halyard" in sys.modules:
        monkeypatch.delattr(sys.modules["halyard"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)  # importing it raises ImportError
    entry = importlib.import_module("__spark_entry__")
    names, oracles = set(entry.queries()), set(entry.oracle_sql())
    assert {"d05_spending_profile", "j06_tfidf_search", "i04_tune_gbt"} <= names and oracles <= names
    assert "pipeline" not in names and (missing == "corpus_pipeline" or not any(n.startswith("op") for n in names))
