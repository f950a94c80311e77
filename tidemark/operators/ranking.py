"""Ranking of the day's candidates, latest rows, universe comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankingConfig
from ..functions import by_date, min_max
from .features import COMPONENTS


def ranked(signals: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """One row per (date, candidate): component scores over that day's candidates alone,
    their weighted sum and the rank by it (ties by ticker, unknown scores last). A
    component whose column is missing scores 0 and its weight is not shared out."""
    buys = signals.where("buy_signal")
    scores = {s: F.coalesce(min_max(F.col(c), by_date(), invert), F.lit(None).cast("double")) if c in signals.columns else F.lit(0.0) for s, (c, invert) in COMPONENTS.items()}
    buys = buys.drop(*COMPONENTS).withColumns(scores)
    total = reduce(Column.__add__, [F.col(s) * w for s, w in cfg.weights().items()])
    buys = buys.withColumn("composite_score", total).withColumn("signal_strength", F.coalesce("signal_strength", F.lit(0.0)))
    place = F.row_number().over(by_date().orderBy(F.col("composite_score").desc_nulls_last(), "ticker"))
    return buys.withColumn("rank", place).select("rank", "ticker", "date", "composite_score", "signal_strength", *COMPONENTS)


def top(rankings: DataFrame, n: int = 5, date: str | None = None) -> DataFrame:
    """The first n of a date, by default of the latest."""
    if date:
        return rankings.where((F.col("date") == F.lit(date).cast("date")) & (F.col("rank") <= n))
    last = rankings.agg(F.max("date").alias("date"))
    return rankings.join(F.broadcast(last), "date", "left_semi").where(F.col("rank") <= n)  # one row is broadcast


def latest(df: DataFrame) -> DataFrame:
    """The latest row of each ticker; a partial aggregate, no sort."""
    last = F.max_by(F.struct(*df.columns), "date").alias("x")
    return df.groupBy("ticker").agg(last).select("x.*")


def universe_difference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(symbol, status): added (only in ``theirs``), removed, common."""
    a, b = ours.select("symbol").distinct(), theirs.select("symbol").distinct()
    parts = {"added": b.subtract(a), "removed": a.subtract(b), "common": a.intersect(b)}
    return reduce(DataFrame.unionByName, [p.withColumn("status", F.lit(s)) for s, p in parts.items()])


def row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def calendar(df: DataFrame) -> DataFrame:
    """(date, date_idx, next_date) of the distinct dates, from 0. A calendar: one partition."""
    w = Window.orderBy("date")
    return df.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("date_idx"), F.lead("date", 1).over(w).alias("next_date"))
