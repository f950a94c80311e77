"""Bars in files: a folder of CSV files per ticker in, Parquet by ticker in and out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nan_to_null, parse_date
from ..schemas import CSV_BARS, OHLCV

_UNSAFE = r'[&\\/:*?"<>|]'


def safe_filename(ticker: str) -> str:
    return re.sub(_UNSAFE, "_", ticker)


def safe_filename_column(ticker: Column) -> Column:
    return F.regexp_replace(ticker, _UNSAFE, "_")


def ticker_of_path(path: Column) -> Column:
    """File name without its folder and .csv; what a safe name has lost stays lost."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"(?i)\.csv$", "")


def read_csv_bars(spark: SparkSession, folder: str) -> DataFrame:
    """bars_raw of every *.csv in a folder, one file per ticker, first column the date.

    A declared schema (no inference pass); rows without a readable date are dropped,
    unreadable values are null, unreadable files are skipped. ``source_row`` orders the
    rows of a file as they stand in it, for ``clean.deduplicated``."""
    raw = spark.read.schema(CSV_BARS).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.[cC][sS][vV]").csv(folder)
    df = raw.select(ticker_of_path(F.col("_metadata.file_path")).alias("ticker"), parse_date(F.col("date")).alias("date"), *OHLCV, F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("source_row"))
    return nan_to_null(df).where("date is not null")


def write_bars(df: DataFrame, folder: str) -> None:
    """Parquet by ticker: readers of one ticker read its folder alone."""
    df.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").parquet(folder)


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.withColumn("ticker", F.col("ticker").cast("string")).select("ticker", "date", *OHLCV)


def write_csv_bars(df: DataFrame, folder: str) -> None:
    df.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(folder)


def recent(df: DataFrame, days: int, column: str = "date") -> DataFrame:
    """Rows of the last ``days`` days: what a watchlist for the latest date needs of the
    history. The bound comes from an aggregate of the date column alone and is a literal
    in the plan, so it reaches the scan."""
    last = df.agg(F.max(column)).first()[0]
    return df if last is None else df.where(F.col(column) >= F.date_sub(F.lit(last), days))


# ------------------------------------------------------------------------ report sinks


def _one_csv(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)  # reports: small


def export_trade_log(trades: DataFrame, folder: str) -> None:
    money, share = ("entry_price", "exit_price", "pnl"), ("pnl_pct",)
    _one_csv(trades.withColumns({c: F.round(c, 2) for c in money} | {c: F.round(c, 6) for c in share}), folder)


def export_equity_curve(equity: DataFrame, folder: str) -> None:
    _one_csv(equity.withColumns({c: F.round(c, 2) for c in ("cash", "invested_value", "total_equity")} | {"exposure_pct": F.round("exposure_pct", 6)}).orderBy("date"), folder)


def export_watchlist(rankings: DataFrame, folder: str, date: str | None = None, n: int = 10) -> None:
    from ..operators.ranking import top

    _one_csv(top(rankings, n, date).orderBy("rank"), folder)
