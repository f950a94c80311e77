"""Cleaning of raw bars: names, gaps, validity, quality gate. One lazy plan, one exchange by ticker."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DataConfig
from ..functions import by_ticker, forward_filled, nan_to_null
from ..schemas import OHLCV


def standardise_columns(df: DataFrame) -> DataFrame:
    """Names stripped, in lower case, with spaces as underscores; the first of equal names stays."""
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns]
    keep = [names.index(n) == i for i, n in enumerate(names)]
    unique = df.toDF(*[n if k else f"_drop_{i}" for i, (n, k) in enumerate(zip(names, keep, strict=True))])
    return unique.drop(*[f"_drop_{i}" for i, k in enumerate(keep) if not k])


def require_columns(df: DataFrame, columns: tuple[str, ...] = OHLCV) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def deduplicated(df: DataFrame, order: str | None = None) -> DataFrame:
    """One bar per (ticker, date): the last in ``order`` (else the largest by its values)."""
    by = [F.col(order).desc()] if order else [F.col(c).desc_nulls_last() for c in OHLCV]
    place = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*by))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def _any_null(columns: tuple[str, ...] = OHLCV) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])


def fill_gaps(df: DataFrame, limit: int = 5) -> DataFrame:
    """Every price and the volume carried forward over at most ``limit`` missing bars."""
    return df.withColumns({c: forward_filled(F.col(c), limit) for c in OHLCV})


def is_valid() -> Column:
    return (F.col("high") >= F.col("low")) & reduce(Column.__and__, [F.col(c) > 0 for c in OHLCV[:4]]) & (F.col("volume") >= 0)


def flagged(raw: DataFrame, cfg: DataConfig) -> DataFrame:
    """Bars with gaps filled, ``_nulls_before``, ``_nulls_after`` and ``_kept``."""
    nulls = lambda: sum(F.col(c).isNull().cast("int") for c in OHLCV)
    df = require_columns(nan_to_null(raw)).withColumn("_nulls_before", nulls())
    df = fill_gaps(df, cfg.ffill_limit).withColumn("_nulls_after", nulls())
    return df.withColumn("_kept", ~_any_null() & F.coalesce(is_valid(), F.lit(False)))


def cleaning_stats(raw: DataFrame, cfg: DataConfig = DataConfig()) -> DataFrame:
    """One row per ticker: what was filled, removed and kept, and whether it is accepted."""
    n = F.count(F.lit(1))
    kept = F.sum(F.col("_kept").cast("long"))
    stats = flagged(raw, cfg).groupBy("ticker").agg(
        n.alias("raw_rows"),
        F.sum(F.col("_nulls_before") - F.col("_nulls_after")).cast("long").alias("gaps_filled"),
        F.sum(((F.col("_nulls_after") == 0) & ~F.col("_kept")).cast("long")).alias("invalid_rows_removed"),
        kept.alias("final_rows"),
        (F.sum("_nulls_before") / (n * len(OHLCV))).alias("missing_pct"),
        (1 - kept / n).alias("removed_pct"),
    )
    accepted = F.col("removed_pct") <= cfg.max_missing_pct
    return stats.withColumn("accepted", accepted).withColumn("rejection_reason", F.when(~accepted, "too many rows missing or invalid"))


def clean(raw: DataFrame, cfg: DataConfig = DataConfig()) -> DataFrame:
    """Filled, valid bars of the accepted tickers. The gate's share is a window over the
    same exchange by ticker, so nothing is read or shuffled twice."""
    w = Window.partitionBy("ticker")
    share = 1 - F.sum(F.col("_kept").cast("long")).over(w) / F.count(F.lit(1)).over(w)
    return flagged(raw, cfg).withColumn("_share", share).where(F.col("_kept") & (F.col("_share") <= cfg.max_missing_pct)).select(raw.columns)


def cleaning_report(stats: DataFrame) -> DataFrame:
    """tickers_processed, tickers_kept, tickers_dropped."""
    kept = F.sum(F.col("accepted").cast("long"))
    return stats.agg(F.count(F.lit(1)).alias("tickers_processed"), kept.alias("tickers_kept"), (F.count(F.lit(1)) - kept).alias("tickers_dropped"))


def null_shares(df: DataFrame) -> DataFrame:
    """One row: percentage of nulls in each column."""
    return df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns])


__all__ = ["clean", "cleaning_report", "cleaning_stats", "deduplicated", "fill_gaps", "is_valid", "null_shares", "require_columns", "standardise_columns"]
