"""Two-phase duplicates: digests first, whole rows only where a digest repeats."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercata.operators import quality as ql

ROWS = [(1, "a", None), (1, "a", None), (None, "a", 1), (1, None, None), (None, None, None), (None, None, None), (2, "b", 3), (1, "a", None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "x int, `a.b` string, z int")


def rows(d):
    return Counter(tuple(r) for r in d.collect())


@pytest.mark.parametrize("threshold", ["10m", "-1"])  # digests broadcast, or joined
def test_duplicates_by_digest(spark, df, threshold):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", {"10m": "10485760", "-1": "-1"}[threshold])
    try:
        assert rows(ql.duplicate_rows(df)) == Counter({(1, "a", None): 3, (None, None, None): 2})
        assert rows(ql.duplicate_rows(df, keep="first")) == Counter({(1, "a", None): 2, (None, None, None): 1})
        assert rows(ql.dedupe_stored(df)) == Counter(set(ROWS)) == rows(ql.dedupe(df))
        assert ql.duplicate_rows(df.limit(0)).collect() == [] == ql.dedupe_stored(df.limit(0)).collect()
        with pytest.raises(ValueError):
            ql.duplicate_rows(df, keep="last")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_clash_of_digests_lists_nobody(spark, df, monkeypatch):
    """All rows get one digest: still only equal rows are duplicates."""
    monkeypatch.setattr(ql, "_digests", lambda columns: [F.lit(7).cast("bigint").alias("_d1"), F.lit(8).cast("bigint").alias("_d2")])
    assert rows(ql.duplicate_rows(df)) == Counter({(1, "a", None): 3, (None, None, None): 2})
    assert rows(ql.dedupe_stored(df)) == Counter(set(ROWS))


def test_only_repeated_rows_travel_whole(spark, sf_dir, tmp_path):
    """Shuffled bytes on the stored retail log: below half of one exchange of all rows."""
    from mercata.sources.fixtures import retail_transactions

    path = str(tmp_path / "log")
    retail_transactions(spark, sf_dir).write.parquet(path)
    log = spark.read.parquet(path)

    def shuffled(frame):
        """Bytes of all exchanges of the plan that ran, and of the digests counted before it."""
        frame.collect()
        found, todo = 0, [frame._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if name.endswith("QueryStage"):
                todo.append(node.plan())
                continue
            if name == "Exchange":
                found += node.metrics().apply("dataSize").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found

    whole = shuffled(log.groupBy(*log.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    digests = ql._digests(log.columns)
    counted = shuffled(log.select(*digests).groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    suspects = ql._suspects(log)
    assert counted + shuffled(suspects.groupBy(*log.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")) < whole / 2
