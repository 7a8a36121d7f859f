"""Readers, cleaning primitives and sinks."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mercata.operators import quality as ql
from mercata.sources import tables as tb
from mercata.sources.sinks import expire_versions, publish_report, read_report, stage_report, switch_report, write_report

AB_CSV = """,user id,test group,converted,total ads,most ads day,most ads hour
0,1069124,ad,False,130,Monday,20
1,1119715,ad,False,93,Tuesday,22
2,1144181,psa,True,21,Tuesday,18
"""

RETAIL_CSV = """,InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
0,572558,22745,POPPY'S PLAYHOUSE BEDROOM,6,2011-10-25 08:26:00,2.10,14286,United Kingdom
1,577485,23196,VINTAGE LEAF MAGNETIC NOTEPAD,1,2011-11-20 11:56:00,1.45,16360,United Kingdom
2,577485,23196,VINTAGE LEAF MAGNETIC NOTEPAD,1,2011-11-20 11:56:00,1.45,16360,United Kingdom
"""


def _write(text: str) -> str:
    folder = tempfile.mkdtemp(prefix="mercata-csv-")
    path = os.path.join(folder, "data.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_ab_csv_with_index_and_spaced_headers(spark):
    df = tb.snake_columns(tb.read_csv(spark, _write(AB_CSV), tb.AB_RAW, index_column=True))
    assert df.columns == ["user_id", "test_group", "converted", "total_ads", "most_ads_day", "most_ads_hour"]
    rows = df.orderBy("user_id").collect()
    assert rows[2].converted is True and rows[0].total_ads == 130


def test_retail_csv_with_date_parsing(spark):
    df = tb.read_csv(spark, _write(RETAIL_CSV), tb.RETAIL, index_column=True, timestamp_format="yyyy-MM-dd HH:mm:ss")
    assert df.schema == tb.RETAIL
    r = df.orderBy("InvoiceNo").first()
    assert r.InvoiceDate == dt.datetime(2011, 10, 25, 8, 26) and str(r.UnitPrice) == "2.10"
    assert ql.duplicate_rows(df).count() == 2
    assert ql.duplicate_rows(df, keep="first").count() == 1
    assert ql.dedupe(df).count() == 2


def test_timestamp_cast(spark):
    df = spark.createDataFrame([("2011-01-02 03:04:05",)], "t string")
    out = tb.to_timestamp_column(df, "t").first().t
    assert out == dt.datetime(2011, 1, 2, 3, 4, 5)


def test_drop_rows_by_key_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    gone = spark.createDataFrame([(2, None)], "k int, v string")
    assert sorted(r.k for r in ql.drop_rows(df, gone).collect()) == [1, 3]


def test_outliers_and_their_complement(spark):
    df = spark.createDataFrame([(1.0,), (2500.0,), (None,)], "p double")
    assert ql.outlier_rows(df, "p", 2000).count() == 1
    assert ql.drop_outliers(df, "p", 2000).count() == 2


def test_replicate_rows_spreads_large_counts(spark):
    df = spark.createDataFrame([("x", 25), ("y", 0), ("z", 3)], "k string, n int")
    out = ql.replicate_rows(df, "n", chunk=10)
    got = {r.k: r.c for r in out.groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert got == {"x": 25, "z": 3}


def test_write_report_partitioned(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="mercata-out-"), "report")
    df = spark.createDataFrame([(dt.date(2022, 8, 24), 1.0), (dt.date(2022, 8, 25), 2.0)], "date date, revenue double")
    write_report(df, folder, partition_by="date")
    back = spark.read.parquet(folder).where(F.col("date") == dt.date(2022, 8, 25)).collect()
    assert [r.revenue for r in back] == [2.0]


def test_write_delivery_dashboard(spark, sf_dir):
    from mercata.operators.economics import cost_model_frame
    from mercata.plans import dashboards
    from mercata.plans.registry import QUERIES
    from mercata.sources.fixtures import delivery_tables

    out = tempfile.mkdtemp(prefix="mercata-dash-")
    tables = delivery_tables(spark, sf_dir)
    model = cost_model_frame(spark)
    paths = dashboards.write_dashboard(
        tables, lambda t, c: dashboards.delivery_overview(t, model, c), out
    )
    assert len(paths) == 10
    back = spark.read.parquet(os.path.join(out, "gross_profit"))
    want = QUERIES["gross_profit"](spark, sf_dir)
    assert sorted(map(tuple, back.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    rpaths = dashboards.write_dashboard(tables, dashboards.retention_overview, out)
    assert len(rpaths) == 5


def test_published_report_survives_a_cut_off_write(spark, tmp_path):
    path = str(tmp_path / "report")
    old = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, n int").withColumn("date", F.to_date("date"))
    publish_report(old, path, partition_by="date")
    rows = lambda: sorted((str(r.date), r.n) for r in read_report(spark, path).collect())
    assert rows() == [("2024-01-01", 1), ("2024-01-02", 2)]
    new = old.withColumn("n", F.col("n") * 10)
    stage_report(new, path, partition_by="date")  # written, and then the job dies
    assert rows() == [("2024-01-01", 1), ("2024-01-02", 2)]
    # a job that dies while it writes
    with pytest.raises(Exception):
        publish_report(new.withColumn("n", F.when(F.col("n") > 10, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).cast("int")), path, partition_by="date")
    assert rows() == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert read_report(spark, path).schema == old.select("n", "date").schema or set(read_report(spark, path).columns) == {"date", "n"}
    assert len(expire_versions(spark, path)) >= 1 and rows() == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_a_day_is_run_again_without_the_others(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = lambda rows: spark.createDataFrame(rows, "date string, n int").withColumn("date", F.to_date("date"))
    assert publish_report(frame([("2024-01-01", 1), ("2024-01-02", 2)]), path, "date") == 1
    assert publish_report(frame([("2024-01-02", 5), ("2024-01-02", 6), ("2024-01-03", 7)]), path, "date", only_parts=True) == 2
    got = read_report(spark, path)
    assert sorted((str(r.date), r.n) for r in got.collect()) == [("2024-01-01", 1), ("2024-01-02", 5), ("2024-01-02", 6), ("2024-01-03", 7)]
    assert dict(got.dtypes)["date"] == "date"
    with pytest.raises(ValueError):
        publish_report(frame([("2024-01-02", 5)]).withColumn("m", F.lit(1)), path, "date", only_parts=True)
    with pytest.raises(ValueError):
        publish_report(frame([]), path, only_parts=True)
    assert publish_report(frame([]), path, "date") == 3
    assert read_report(spark, path).collect() == [] and read_report(spark, path).columns == ["date", "n"]


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    from mercata.sources import sinks

    path = str(tmp_path / "report")
    df = spark.range(3).toDF("n")
    publish_report(df, path)
    staged, seen = stage_report(df.limit(1), path), sinks._manifest(spark, path)
    publish_report(df.limit(2), path)
    monkeypatch.setattr(sinks, "_manifest", lambda *_: seen)  # it looked before the other one switched
    with pytest.raises(RuntimeError):
        switch_report(spark, path, staged)
    monkeypatch.undo()
    assert read_report(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        read_report(spark, str(tmp_path / "none"))


def test_rows_are_dropped_by_place(spark, tmp_path):
    """Places run through the files in order, whatever the splits."""
    path = str(tmp_path / "t")
    for i, (a, b) in enumerate([(0, 10), (10, 11), (11, 40)]):
        spark.range(a, b, numPartitions=1).selectExpr("id", "id % 3 AS `a.b`").write.parquet(f"{path}/part{i}")
    paths = [f"{path}/part{i}" for i in range(3)]
    got = tb.row_positions(spark, *paths).collect()
    assert sorted((r.position, r.id) for r in got) == [(i, i) for i in range(40)]
    kept = tb.drop_row_at(spark, [0, 9, 10, 39, 99], *paths)
    assert kept.columns == ["id", "a.b"]
    assert sorted(r.id for r in kept.collect()) == [i for i in range(40) if i not in (0, 9, 10, 39)]
    with pytest.raises(KeyError):
        tb.drop_row_at(spark, [99], *paths, missing="raise")
    assert tb.drop_row_at(spark, [], *paths, missing="raise").count() == 40
