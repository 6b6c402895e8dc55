"""Every query that SQL can say, against DuckDB on the smallest tables."""

import importlib

import pytest

from tests.helpers import connect, rows, sql_rows

MODULES = [importlib.import_module(f"quirelab.plans.{m}") for m in ("general", "corpus", "experiments", "pipelines", "sourcing")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
#: Too few rows at this size (a series of 1000 points, 1000 lines): the statistic is undefined there.
SKIP = {"mfdfa_by_group", "novelty_survival", "mfdfa_spectrum"}


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SKIP))
def test_matches_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    names, want = sql_rows(db, ORACLE[name])
    assert sorted(df.columns) == names
    assert rows(df) == want


@pytest.mark.parametrize("name", ["source_hashes", "joint_signature_rest", "compression_profile", "huffman_codes", "pa_grid", "bpe_vocab"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
