import importlib
import sys

import pytest


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("absent", ["corpus_pipeline", "heddle.llm"])
def test_works_without_the_subpackage(monkeypatch, absent):
    for name in [m for m in sys.modules if m in ("__spark_entry__", "corpus_pipeline") or m.startswith("heddle.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == absent:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "fact_screen_gene" in entry.queries() and not any(q.startswith("op") and q[2].isdigit() for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    files = [p for p in (top / "heddle").rglob("*.py") if "llm" not in p.parts] + [p for p in (top / "tests").glob("*.py") if p.name != "test_entry.py"]
    assert not [p for p in files if "heddle.llm" in p.read_text()]
