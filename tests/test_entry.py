"""The driver contract stands without the training-data operators, or without modules that only they need."""
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "jobscope.llm", "corpus_pipeline"])
def test_missing_modules_leave_the_engine_queries(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); " \
           "print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len(set(o) - set(q)), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    engine, loose, pipeline = done.stdout.split()
    assert int(engine) >= 100 and loose == "0" and pipeline == "False"


def test_every_engine_query_has_an_oracle():
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if not n.startswith('op') and n != 'pipeline' and n not in e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "[]"
