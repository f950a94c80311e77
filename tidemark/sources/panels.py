"""Bar panels made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ohlc(df: DataFrame, keys: list[str], order: list[str], volume: str) -> DataFrame:
    at = F.struct(*order, "price")
    return df.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum(volume).cast("double").alias("volume")
    )


def bars_daily(spark: SparkSession, folder: str, ticker: str = "p_brand") -> DataFrame:
    """Daily bars of part brands (or types) from line items: prices per unit in order of
    order key and line. The scan reads six columns; the part table joins by its size."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker"))
    line = table(spark, folder, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity")
    return _ohlc(line.join(part, "l_partkey"), ["ticker", "date"], ["l_orderkey", "l_linenumber"], "l_quantity")


def index_daily(bars: DataFrame) -> DataFrame:
    """The mean close of all tickers by date."""
    return bars.groupBy("date").agg(F.avg("close").alias("close"))


def vix_daily(spark: SparkSession, folder: str) -> DataFrame:
    """A second calendar: mean order value by order date."""
    return table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1000).alias("close"))


def bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("date"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("one"))
    return _ohlc(e, ["ticker", "date"], ["ts", "event_id"], "one")


def bars_gapped(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with deterministic gaps and invalid rows, for the cleaning operators."""
    b = bars_daily(spark, folder)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    gap = F.pmod(day + F.ascii(F.substring("ticker", 7, 1)), F.lit(11)) == 0
    bad = F.pmod(day, F.lit(17)) == 0
    b = b.withColumns({c: F.when(~gap, F.col(c)) for c in ("open", "close")})
    return b.withColumn("volume", F.when(bad, -F.col("volume")).otherwise(F.col("volume")))
