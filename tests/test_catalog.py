import sys

import pytest
from oracle import compare

from vicinity import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    if name in SQL:
        compare(spark, sf_dir, QUERIES[name], SQL[name])
    else:
        QUERIES[name](spark, sf_dir).collect()


def test_entry_routes_documents(spark, monkeypatch, sf_dir):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["outcome"] for r in rows} <= {"queued", "candidate", "dropped", "retry"}


def test_library_does_not_import_llm():
    import pathlib

    import vicinity

    root = pathlib.Path(vicinity.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "vicinity.llm" not in path.read_text(), path
    assert "vicinity" in sys.modules
