"""The entry module stands without the corpus operators or a library of theirs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
IMPORT = """
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "b7_sold_metrics" in names, len(names)
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("missing", ["estate_spark.llm", "corpus_pipeline", "public_tokenizers", "sentencepiece", "zstandard"])
def test_queries_without_the_corpus_libraries(missing):
    done = subprocess.run([sys.executable, "-c", IMPORT.format(missing=missing)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
