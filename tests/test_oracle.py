"""Every oracle-checkable query equals its independent DuckDB statement.

Runs at sf0.001 by default (MERCATA_TEST_SF_DIR=/root/testdata/sf0.01 for
the driver's scale).
"""

from __future__ import annotations

import pytest

from mercata.plans.oracle import SQL
from mercata.plans.registry import QUERIES
from oracle_check import compare


def test_every_oracle_key_is_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, sf_dir, duck_con, name):
    ok, msg = compare(spark, name, sf_dir, duck_con)
    assert ok, msg


ROWS_ONLY = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(df.columns) > 0
    assert df.count() >= 0
