"""Every query with an SQL equivalent gives the same rows as DuckDB."""

import compare
import pytest

from stackroom.plans import queries, write_queries  # noqa: F401
from stackroom.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    (mine, theirs), here, there, _ = compare.differences(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert mine == theirs
    assert not here and not there


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["file_id", "path", "src", "rank"]
