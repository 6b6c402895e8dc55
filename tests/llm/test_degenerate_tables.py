"""Every p query over empty tables, over rows of nothing but nulls, and over tables with extra columns."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quirelab.llm.queries import QUERIES
from quirelab.plans import general
from tests.helpers import rows

ALL = QUERIES | general.QUERIES
#: Their rows are per target or per annotator, so they are there without data.
FIXED = {"p9_shares", "p6_reliability", "p6_alpha"}


def write(data, out, change):
    os.makedirs(out, exist_ok=True)
    for p in glob.glob(f"{data}/*.parquet"):
        pq.write_table(change(pq.read_table(p)), f"{out}/{os.path.basename(p)}")
    return str(out)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return write(data, tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))


@pytest.fixture(scope="module")
def nulls(data, tmp_path_factory):
    return write(data, tmp_path_factory.mktemp("nulls"), lambda t: pa.table({n: pa.nulls(3, t.schema.field(n).type) for n in t.column_names}))


@pytest.fixture(scope="module")
def wider(data, tmp_path_factory):
    extra = ["key", "rep", "pos", "term", "words", "record_id", "h", "seed", "source_key", "_a", "_row", "side", "version", "record_key", "at", "vertex", "member", "component", "level", "prose", "n_tokens", "item", "pattern", "kind", "x"]

    def change(t):
        for n in extra:
            if n not in t.column_names:
                t = t.append_column(n, pa.array(["clash"] * t.num_rows))
        return t

    return write(data, tmp_path_factory.mktemp("wider"), change)


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty(spark, empty, name):
    got = ALL[name](spark, empty).count()
    assert got == 0 or name in FIXED


@pytest.mark.parametrize("name", sorted(ALL))
def test_only_nulls(spark, nulls, name):
    got = ALL[name](spark, nulls).count()
    assert got == 0 or name in FIXED


@pytest.mark.parametrize("name", sorted(n for n in ALL if n.endswith("_found")))
def test_extra_columns(spark, data, wider, name):
    assert rows(ALL[name](spark, wider)) == rows(ALL[name](spark, data))
