"""Every llm query: against DuckDB where SQL can say it, else that it runs and keeps its form."""

import pytest

from quirelab.llm.oracle import ORACLE
from quirelab.llm.queries import QUERIES
from tests.helpers import connect, rows, sql_rows


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    names, want = sql_rows(db, ORACLE[name])
    assert sorted(df.columns) == names
    assert rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_nothing_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "quirelab"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "quirelab.llm" not in p.read_text()
