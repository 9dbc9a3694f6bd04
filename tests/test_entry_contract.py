"""The driver contract in __spark_entry__.py."""

import importlib.util
from pathlib import Path

from ranklab.plans.layers import GOLD_COLUMNS


def _entry_module():
    path = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract_shapes(spark):
    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    corpus = {n for n in q if n == "pipeline" or n.startswith("op")}
    assert set(q) - set(o) - corpus == {"gbt_training", "ml_forecast"}
    assert bool(corpus) == mod.HAS_LLM  # registered when, and only when, the optional folder is there
    assert all(callable(f) for f in q.values())
    df = mod.entry(spark)
    assert tuple(df.columns) == GOLD_COLUMNS
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_missing_package_takes_only_the_corpus_queries(monkeypatch):
    import sys
    for name in [m for m in sys.modules if m.startswith(("ranklab.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # importing it raises ImportError
    mod = _entry_module()
    assert not mod.HAS_LLM and "gold_features" in mod.queries() and "gold_features" in mod.oracle_sql()
    assert not any(n == "pipeline" or n.startswith("op") for n in mod.queries())
