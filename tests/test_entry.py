"""The driver contract without the corpus operators or a library that only they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["ahocorasick", "sentencepiece", "corpus_pipeline", "logloom.llm"])
def test_core_queries_stay_when_a_module_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q) > 50, 'incident_members' in q, set(s) <= set(q), any(n.startswith('op') for n in q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert got.stdout.split() == ["True", "True", "True", "False"], got.stderr[-500:]


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert all(callable(f) for f in queries.values()) and set(__spark_entry__.oracle_sql()) <= set(queries)
