"""Every registered query against its DuckDB oracle (the driver's check),
at the smallest scale so the suite stays quick; tests/oracle_harness.py runs
the same at sf0.01."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare, duck_con

# the optional subpackage's queries are tested in their own folder
NAMES = sorted(set(E.queries()) - set(E.EXTRA))


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if n not in E.oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["match"], r


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["directory", "todo", "done"]
    assert df.count() > 0
