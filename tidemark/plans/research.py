"""Panel to signals as one lazy plan: an exchange by ticker, one by date, small calendars joined."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import clean, features, indicators, metrics, ranking, regime, signals, simulate


@dataclass(frozen=True)
class Research:
    """Lazy tables of a run."""

    features: DataFrame
    regime: DataFrame
    signals: DataFrame
    rankings: DataFrame


@dataclass(frozen=True)
class Backtest:
    equity: DataFrame
    trades: DataFrame
    metrics: DataFrame
    benchmark: DataFrame | None = None
    runs: DataFrame | None = None

    def release(self) -> None:
        """Frees what ``backtest`` persisted; its tables can still be read."""
        if self.runs is not None:
            self.runs.unpersist()


def research(bars: DataFrame, index: DataFrame, vix: DataFrame | None = None, cfg: Config = Config(), raw: bool = False) -> Research:
    """Cleaning (if ``raw``), indicators, features, regime, signals, rankings. The index
    series are tables of their own and never enter the cross-section. Of raw bars with the
    same ticker and date the last in ``source_row`` stays, if the bars have that column."""
    cfg.validate()
    if raw:
        bars = clean.clean(clean.deduplicated(bars, "source_row" if "source_row" in bars.columns else None).drop("source_row"), cfg.data)
    feats = features.with_all(indicators.with_all(bars, cfg.indicators), index, cfg.ranking)
    market = regime.regimes(index, vix, cfg.regime)
    sig = signals.with_all(feats, market, cfg.signals, cfg.regime)
    return Research(feats, market, sig, ranking.ranked(sig, cfg.ranking))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed now and read from there, so that what follows plans on one scan: a
    checkpoint in the shared folder where the session has one (``spark.checkpoint.dir``), else
    in the process of a local master. On a cluster without such a folder ``df`` as it is."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir():
        return df.checkpoint()
    return df.localCheckpoint() if re.fullmatch(r"local(\[[^]]*\])?", sc.master) else df


def backtest(r: Research, cfg: Config = Config(), benchmark: DataFrame | None = None, spark: SparkSession | None = None) -> Backtest:
    """Simulates the configured scenario; the reduced panel of days is the fold's only input.
    The fold runs once for both tables: its one row is persisted (a row of equity a date)
    until ``Backtest.release``, and computed again if its executor is lost.

    Signals, rankings and regime repeat the panel's plan many times over and the metrics read
    the run five times, so the columns that the fold needs are settled first: planned as one,
    they take more than a gigabyte of the driver."""
    spark = spark or r.signals.sparkSession
    seen = settled(r.signals.select(*simulate.SEEN))
    days = simulate.days_of(seen, settled(r.rankings.select("date", "ticker", "rank")), settled(r.regime.select("date", "regime")), cfg.regime)
    which = simulate.scenarios(spark, cfg.backtest)
    runs = simulate.simulated(days, which, cfg.backtest, cfg.signals).persist()
    equity, trades = simulate.equity_of(runs), simulate.trades_of(runs)
    held = simulate.benchmark_equity(benchmark, cfg.backtest.initial_capital) if benchmark is not None else None
    return Backtest(equity, trades, metrics.compute_all(equity, trades), held, runs)


def watchlist(r: Research, n: int = 10) -> DataFrame:
    """The first n candidates of the latest date that has any."""
    return ranking.top(r.rankings, n)


def latest_stretched(bars: DataFrame, n: int = 5) -> DataFrame:
    """The n tickers furthest below their 20-day mean on their latest bar."""
    df = bars.withColumns({"zscore": indicators.zscore(F.col("close")), "volume_spike": indicators.volume_spike(F.col("volume"))})
    return ranking.latest(df).where("zscore is not null").orderBy("zscore", "ticker").limit(n).select("ticker", "date", "close", "zscore", "volume_spike")
