"""What is registered when the training-data subpackage, or a library it needs, is missing."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from gradewell.plans import registry

ROOT = entry.os.path.dirname(entry.os.path.abspath(entry.__file__))


@pytest.mark.parametrize("missing", ["gradewell.llm", "public_tokenizers", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
        "from gradewell.plans import registry as r; "
        "assert set(r.queries()) <= set(e.queries()) and 'pipeline' not in e.queries(); "
        "assert e.oracle_sql().keys() >= r.queries().keys()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_queries_are_registered():
    assert set(registry.queries()) <= set(entry.queries())
