"""The operators that SQL can express give DuckDB's rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import compare  # noqa: E402

from stackroom.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, name):
    (mine, theirs), here, there, _ = compare.differences(QUERIES[name](spark, sf_dir), compare.connect(sf_dir), ORACLE[name])
    assert mine == theirs and not here and not there
