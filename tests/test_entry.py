"""The driver contract, and the library without its text operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from spanforge import queries
from tests import oracle

ROOT = Path(__file__).parents[1]
pytestmark = pytest.mark.skipif(not Path(oracle.DATA).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_against_sql(spark, name):
    oracle.agree(spark, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_text_operators():
    """The folders may be deleted: the rest must import and list its queries."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("spanforge.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and len(e.queries()) == len(e.oracle_sql()) > 80 and not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
import spanforge.core
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_imports_the_text_operators():
    for path in (ROOT / "spanforge").rglob("*.py"):
        if "llm" not in path.parts:
            assert "spanforge.llm" not in path.read_text(), path


def test_a_missing_library_is_no_missing_subpackage():
    """What the text operators need must be there: only their own absence is passed over."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "xxhash":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
try:
    import __spark_entry__
except ModuleNotFoundError as e:
    assert e.name == "xxhash"
else:
    raise SystemExit(int("spanforge.llm" in sys.modules))
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
