"""The driver's entry stands without the training-data part, or without a package which that part needs."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import registered_queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
print(len(entry.queries()), sorted(set(entry.oracle_sql()) - set(entry.queries())))
"""


def run(hidden):
    return subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("hidden", [["grainwise.llm", "corpus_pipeline"], ["grainwise.llm"], ["public_tokenizers"], ["ahocorasick"]])
def test_other_queries_remain(hidden):
    found = run(hidden)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[0]) >= len(registered_queries.queries()) and "[]" in found.stdout
    part_is_here = os.path.isdir(os.path.join(ROOT, "grainwise", "llm"))
    assert ("left out" in found.stderr) == (part_is_here and hidden[0] in ("public_tokenizers", "ahocorasick"))


def test_a_fault_inside_the_library_is_an_error():
    assert run(["grainwise.operators"]).returncode != 0
