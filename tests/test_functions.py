"""Shared column functions and the streams."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import as_of, business_dates, min_max, nan_to_null, parse_date, run_lengths, since_months
from tidemark.log import get_logger
from tidemark.operators import features

DAY = dt.date(2024, 1, 1)


def test_dates(spark):
    got = [r.date for r in business_dates(spark, "2024-01-01", "2024-02-15").collect()]
    assert got == [d.date() for d in pd.bdate_range("2024-01-01", "2024-02-15")]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(400)], "date date")
    assert since_months(df, 6).agg(F.min("date")).first()[0] == dt.date(2024, 8, 4)
    texts = spark.createDataFrame([("2024-03-04",), ("junk",), (None,)], "t string").select(parse_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in texts] == [dt.date(2024, 3, 4), None, None]


def test_as_of_by_key(spark):
    left = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), i) for i in range(0, 10, 2)] + [("B", DAY, 0)], "ticker string, date date, n int")
    right = spark.createDataFrame([("A", DAY + dt.timedelta(days=3), 1.0), ("A", DAY + dt.timedelta(days=6), None), ("A", DAY + dt.timedelta(days=8), 2.0)], "ticker string, date date, v double")
    got = {(r.ticker, r.n): r.v for r in as_of(left, right, "v", ["ticker"]).collect()}
    assert got == {("A", 0): None, ("A", 2): None, ("A", 4): 1.0, ("A", 6): 1.0, ("A", 8): 2.0, ("B", 0): None}


def test_nulls_and_ranges(spark):
    df = spark.createDataFrame([(DAY, 1.0), (DAY, float("nan")), (DAY, 3.0)], "date date, x double")
    assert sorted((r.x for r in nan_to_null(df).collect()), key=str) == [1.0, 3.0, None]
    from pyspark.sql import Window

    got = nan_to_null(df).withColumn("s", min_max(F.col("x"), Window.partitionBy("date"), invert=True)).collect()
    assert {(r.x, r.s) for r in got} == {(1.0, 1.0), (3.0, 0.0), (None, None)}
    runs = run_lengths(spark.createDataFrame([(DAY + dt.timedelta(days=i), x) for i, x in enumerate(["a", "a", None, None, "b"])], "date date, l string"), "l", Window.orderBy("date"))
    assert [r.run_id for r in runs.orderBy("date").collect()] == [1, 1, 2, 2, 3]
    values = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    w = features.winsorised(values, "x", 0.1, 0.9).agg(F.min("x"), F.max("x")).first()
    assert tuple(w) == (10.0, 90.0)
    assert features.normalised(values.where("x = 3"), "x").first().x is None


def test_logger(tmp_path):
    log = get_logger("tidemark-test", folder=str(tmp_path))
    log.info("hello")
    assert get_logger("tidemark-test") is log and "hello" in (tmp_path / "tidemark-test.log").read_text()


def test_running_mean(spark, tmp_path):
    from tidemark.streaming import running_mean

    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [("A", dt.datetime(2024, 1, 1, 0, i), float(i * i)) for i in range(10)]
        for k in range(2):  # two micro-batches
            spark.createDataFrame(rows[5 * k : 5 * k + 5], "ticker string, ts timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/t/{k}")
        stream = spark.readStream.schema("ticker string, ts timestamp, price double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/t")
        q = running_mean(stream, 0.3).writeStream.format("memory").queryName("means").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = [r["mean"] for r in spark.table("means").orderBy("ts").collect()]
        assert np.allclose(got, pd.Series([r[2] for r in rows]).ewm(alpha=0.3, adjust=False).mean())
    finally:
        spark.conf.unset(key)
