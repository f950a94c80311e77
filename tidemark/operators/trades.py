"""Trades that do not compete for capital: one per entry signal, found by joins alone."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig, SignalConfig
from ..functions import business_days, by_ticker, holds
from .ranking import calendar


def uncoupled_trades(signals: DataFrame, signal_cfg: SignalConfig = SignalConfig(), costs: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(ticker, signal_date, entry_date, entry_price, stop_loss, exit_date, exit_price,
    holding_days, pnl_pct, exit_reason) for every entry signal.

    Entry: open of the next date of the common calendar, skipped if the ticker has no bar
    then. Exit: the first date on which the low reaches the stop, the business days held
    reach the limit, or the ticker has an exit signal, in that order of precedence, at
    that date's close (the entry price if there is no bar). A limit on days bounds the
    dates that a trade can meet, so trades meet their dates by equality on the calendar's
    index, not by a range."""
    days = calendar(signals)
    bars = signals.select("ticker", "date", "low", "close", "sell_signal", "exit_reason")
    w = by_ticker()
    entries = signals.select("ticker", F.col("date").alias("signal_date"), "buy_signal", "atr", F.lead("date", 1).over(w).alias("entry_date"), F.lead("open", 1).over(w).alias("entry_open")).where("buy_signal and entry_open > 0")
    entries = entries.join(days.select(F.col("date").alias("signal_date"), "date_idx", F.col("next_date").alias("entry_date")), ["signal_date", "entry_date"])
    price = F.col("entry_open") * (1 + costs.buy_cost + costs.slippage)
    entries = entries.withColumn("entry_price", price).withColumn("stop_loss", F.col("entry_price") - signal_cfg.atr_stop_multiplier * F.col("atr"))
    reach = ceil(signal_cfg.max_hold_days / 5) * 7 + 2  # dates until the limit is surely reached
    met = entries.withColumn("date_idx", F.explode(F.sequence(F.col("date_idx") + 1, F.col("date_idx") + 1 + reach)))
    met = met.join(days.select("date_idx", "date"), "date_idx").join(bars, ["ticker", "date"], "left")
    held = business_days(F.col("entry_date"), F.col("date"))
    why = (
        F.when(holds(F.col("low") <= F.col("stop_loss")), "atr_stop")
        .when(held >= signal_cfg.max_hold_days, "time_stop")
        .when(holds(F.col("sell_signal")), F.col("exit_reason"))
    )
    first = F.min(F.when(why.isNotNull(), F.struct("date_idx", "date", F.coalesce("close", "entry_price").alias("price"), why.alias("reason")))).alias("x")
    out = met.groupBy("ticker", "signal_date", "entry_date", "entry_price", "stop_loss").agg(first)
    exit_price = F.col("x.price") * (1 - costs.sell_cost - costs.slippage)
    return out.select(
        "ticker", "signal_date", "entry_date", "entry_price", "stop_loss", F.col("x.date").alias("exit_date"), exit_price.alias("exit_price"),
        F.datediff("x.date", "entry_date").alias("holding_days"), (exit_price / F.col("entry_price") - 1).alias("pnl_pct"), F.col("x.reason").alias("exit_reason"),
    )
