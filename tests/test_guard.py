"""The entry works without the training-text subpackage, and nothing else imports it."""

import importlib
import re
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert entry.llm is None and "q_chunk_documents" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "gradelake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) +gradelake\.llm", p.read_text(), re.M), p
