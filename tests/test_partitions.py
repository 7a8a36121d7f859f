"""Shares of the retail lines: a task's doesn't grow with the table, whatever the session's partitions."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercata.functions import joins
from mercata.operators import cohort as ch
from mercata.operators import quality as ql
from mercata.sources import fixtures as fx

LINES = 6000


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    day = lambda i: dt.datetime(1995, 1, 1) + dt.timedelta(days=i % 700)
    # some lines without an order or a part, some orders without a customer, and lines that come twice
    lines = [(None if i % 97 == 0 else i // 4, None if i % 101 == 0 else i % 50, float(i % 3)) for i in range(LINES - 40)]
    lines += lines[100:140]
    orders = [(i, None if i % 89 == 0 else i % 120, day(i)) for i in range(LINES // 4)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(i, f"part {i % 9}", 900.0 + i) for i in range(49)], "p_partkey long, p_name string, p_retailprice double"),
        "customer": ([(i, None if i == 5 else i % 4) for i in range(118)], "c_custkey long, c_nationkey int"),
        "nation": ([(i, f"nation {i}") for i in range(4)], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, {name: rows for name, (rows, _) in tables.items()}


def largest(df):
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def expected(tables):
    orders, parts, nations = ({r[0]: r for r in tables[t]} for t in ("orders", "part", "nation"))
    customers = {r[0]: r for r in tables["customer"] if r[1] is not None}
    out = Counter()
    for order, part, quantity in tables["lineitem"]:
        if order not in orders or part not in parts or orders[order][1] not in customers:
            continue
        _, customer, day = orders[order]
        row = (order, part, parts[part][1], int(quantity), day, customer if customer % fx.ANONYMOUS_EVERY else None, nations[customers[customer][1]][1])
        out[row] += 2 if order % 37 == 0 else 1
    return out


def test_lines_are_dealt_by_their_count(spark, star, monkeypatch):
    folder, tables = star
    own = lambda d: Counter((r.InvoiceNo, r.StockCode, r.Description, r.Quantity, r.InvoiceDate, r.CustomerID, r.Country) for r in d.collect())
    want = expected(tables)
    for rows, most in ((joins.PART_ROWS, LINES), (50, 300)):
        monkeypatch.setattr(joins, "PART_ROWS", rows)
        tx = fx.retail_transactions(spark, folder)
        assert own(tx) == want and own(ql.dedupe(tx)) == Counter(set(want))
        assert largest(ql.dedupe(tx)) <= most


def test_parts_and_customers_are_met_in_shares_of_the_lines(spark, star, monkeypatch):
    """Where neither fits a broadcast, their joins don't run in the session's partitions either."""
    folder, tables = star
    monkeypatch.setattr(joins, "PART_ROWS", 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = fx.retail_transactions(spark, folder)
        plan = tx._jdf.queryExecution().executedPlan().toString()
        for key in ("l_partkey", "p_partkey", "o_custkey", "c_custkey"):
            assert set(re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan)) == {str(LINES // 50)}, key
        got = Counter((r.InvoiceNo, r.StockCode, r.Description, r.Quantity, r.InvoiceDate, r.CustomerID, r.Country) for r in tx.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == expected(tables)


def test_cohorts_are_assigned_in_shares_of_the_lines(spark, star, monkeypatch):
    folder, _ = star
    tx = ql.dedupe(fx.retail_transactions(spark, folder))
    plain = Counter(ch.cohort_assign(tx).collect())
    monkeypatch.setattr(joins, "PART_ROWS", 50)
    dealt = ch.cohort_assign(ql.dedupe(fx.retail_transactions(spark, folder)))
    assert Counter(dealt.collect()) == plain and plain
    assert largest(dealt) <= 600
