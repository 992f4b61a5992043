"""The entry module works with the llm subpackage and the pipeline, and without them."""

import importlib
import sys

import pytest

import __spark_entry__ as entry_module
from stockroom.plans.registry import queries as own_queries


class _Without:
    """An import hook that hides some modules, as if their files were gone."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if any(name == x or name.startswith(f"{x}.") for x in self.names):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


def _forget(monkeypatch):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name == "stockroom.llm" or name.startswith("stockroom.llm."):
            monkeypatch.delitem(sys.modules, name)


@pytest.mark.parametrize("gone", [("stockroom.llm", "corpus_pipeline"), ("stockroom.llm",)])
def test_queries_without_the_llm_folders(monkeypatch, gone):
    _forget(monkeypatch)
    monkeypatch.setattr(sys, "meta_path", [_Without(*gone), *sys.meta_path])
    assert set(entry_module.queries()) == set(own_queries())
    assert not [n for n in entry_module.oracle_sql() if n.startswith("op") or n == "pipeline"]


def test_other_import_errors_come_out(monkeypatch):
    _forget(monkeypatch)
    monkeypatch.setattr(sys, "meta_path", [_Without("corners_of_no_module"), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        entry_module._optional("corners_of_no_module")


def test_every_sql_has_a_query():
    importlib.reload(entry_module)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
