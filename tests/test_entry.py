"""The driver's entry points, with the training-data operators and without them."""

import subprocess
import sys

import pytest

HIDE = """
import sys
sys.path.insert(0, {root!r})
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith("op") or q == "pipeline" for q in e.queries()))
"""


@pytest.mark.parametrize("hidden", [["streetloom.llm"], ["corpus_pipeline"], ["streetloom.llm", "corpus_pipeline"]])
def test_queries_without_the_training_data_operators(hidden):
    import pathlib

    from streetloom import catalogue

    root = str(pathlib.Path(__file__).parents[1])
    out = subprocess.run([sys.executable, "-c", HIDE.format(root=root, hidden=hidden)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL)), "0"]


def test_every_query_can_be_called():
    import __spark_entry__ as e

    assert all(callable(q) for q in e.queries().values()) and set(e.oracle_sql()) <= set(e.queries())
