import os
import subprocess
import sys

import pytest

from tests.oracle import same
from vectorscape.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), SQL[name], sf)


def test_entry_file_is_complete():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(registry.queries()) <= names
    assert set(e.oracle_sql()) <= names


def test_seeded_layout_and_communities(spark, sf):
    q = registry.queries()
    first, again = ({r.node: (r.x, r.y) for r in q["umap_layout"](spark, sf).collect()} for _ in range(2))
    assert first == again and len(first) == 500
    labels = {r.node: r.community for r in q["leiden_communities"](spark, sf).collect()}
    assert len(labels) == 500 and set(labels.values()) == set(range(max(labels.values()) + 1))


def test_entry_file_without_optional_libraries(tmp_path):
    """Where a library of the training-data operators is missing, the other queries are still there."""
    (tmp_path / "tiktoken.py").write_text("raise ImportError('hidden')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.queries()))"], cwd=root, env=os.environ | {"PYTHONPATH": f"{tmp_path}{os.pathsep}{root}"}, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
