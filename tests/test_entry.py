"""The driver's contract holds with and without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
sys.modules["corpus_pipeline"] = None
sys.modules["shoal.llm"] = None
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"] and set(e.oracle_sql()) <= set(e.queries())
assert len(e.queries()) > 90
"""


def test_entry_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_every_sql_statement_has_a_query():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
