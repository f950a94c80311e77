"""Streams of ticks to bars, and a stateful exponential mean."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bars(ticks: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars of ticks(ticker, ts, seq, price, volume): a watermark bounds the state, and
    ticks that come later than ``delay`` are left out. Works on batches too, where every
    tick counts."""
    at = F.struct("ts", "seq", "price")
    source = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    out = source.groupBy(F.window("ts", width).alias("w"), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks")
    )
    return out.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "ticks")


class RunningMean(StatefulProcessor):
    """Per ticker: y = x at first, then (1 - alpha) * y + alpha * x, over rows in time order
    within each micro-batch."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        y = self.state.get()[0] if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values("ts")
        out = []
        for x in pdf["price"]:
            y = float(x) if y is None else (1 - self.alpha) * y + self.alpha * float(x)
            out.append(y)
        if y is not None:
            self.state.update((y,))
        yield pd.DataFrame({"ticker": key[0], "ts": pdf["ts"].to_numpy(), "mean": out})

    def close(self) -> None:
        pass


def running_mean(ticks: DataFrame, alpha: float) -> DataFrame:
    """(ticker, ts, mean) of ticks(ticker, ts, price), state kept across micro-batches (the
    RocksDB state store is needed)."""
    return ticks.select("ticker", "ts", "price").groupBy("ticker").transformWithStateInPandas(RunningMean(alpha), "ticker string, ts timestamp, mean double", "Append", "None")
