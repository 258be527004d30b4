"""The entry points without the corpus operators, or without a module these need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import sys; {block}; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') for q in e.queries()))"


@pytest.mark.parametrize("module", ["taxaflow.llm", "corpus_pipeline", "xxhash", "tiktoken"])
def test_other_queries_stay_when_a_corpus_module_is_missing(module):
    block = f"sys.modules[{module!r}] = None"
    done = subprocess.run([sys.executable, "-c", COUNT.format(block=block)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, oracles, corpus = map(int, done.stdout.split())
    assert queries >= 115 and oracles >= 115
    assert corpus == 0 or module == "tiktoken"  # only loaded when a text is encoded
