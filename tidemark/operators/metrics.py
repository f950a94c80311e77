"""Performance metrics: aggregates over equity(date, equity), returns(date, ret) and trades.

Equity and return series are calendars; windows over them without a key run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RISK_FREE, TRADING_DAYS
from ..functions import by_calendar, divide, rolling

YEAR = float(TRADING_DAYS)


def daily_returns(equity: DataFrame) -> DataFrame:
    r = divide(F.col("equity"), F.lag("equity", 1).over(by_calendar())) - 1
    return equity.select("date", r.alias("ret")).where("ret is not null")


# -------------------------------------------------------------- aggregate expressions


def cagr() -> Column:
    n, first = F.count("equity"), F.min_by("equity", "date")
    ok = (n >= 2) & (first > 0)
    return F.when(ok, F.pow(F.max_by("equity", "date") / F.nullif(first, F.lit(0.0)), F.lit(YEAR) / F.nullif(n, F.lit(0))) - 1).otherwise(0.0)


def total_return() -> Column:
    return F.coalesce(divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1, F.lit(0.0))


def _ratio(mean: Column, spread: Column, n: Column) -> Column:
    return F.when((n >= 2) & (spread > 0), mean / F.nullif(spread, F.lit(0.0)) * F.sqrt(F.lit(YEAR))).otherwise(0.0)


def sharpe(r: Column, risk_free: float = RISK_FREE) -> Column:
    x = r - risk_free / YEAR
    return _ratio(F.avg(x), F.stddev_samp(x), F.count(r))


def sortino(r: Column, risk_free: float = RISK_FREE) -> Column:
    x = r - risk_free / YEAR
    return _ratio(F.avg(x), F.stddev_samp(F.when(x.isNotNull(), F.least(x, F.lit(0.0)))), F.count(r))


def win_rate() -> Column:
    return F.coalesce(F.avg((F.col("pnl") > 0).cast("double")), F.lit(0.0))


def profit_factor() -> Column:
    """Sum of wins over sum of losses; infinite without losses if anything was won, else 0."""
    won = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.lit(0.0))
    lost = F.abs(F.coalesce(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0)))
    return F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, F.lit(float("inf"))).otherwise(0.0)


def avg_holding_days() -> Column:
    return F.coalesce(F.avg(F.datediff("exit_date", "entry_date").cast("double")), F.lit(0.0))


def exposure() -> Column:
    return F.coalesce(F.avg((F.col("num_positions") > 0).cast("double")), F.lit(0.0))


# ---------------------------------------------------------------------------- series


def drawdowns(equity: DataFrame) -> DataFrame:
    """(date, equity, peak, drawdown)."""
    peak = F.max("equity").over(by_calendar().rowsBetween(Window.unboundedPreceding, 0))
    return equity.select("date", "equity", peak.alias("peak")).withColumn("drawdown", divide(F.col("equity") - F.col("peak"), F.col("peak")))


def max_drawdown(equity: DataFrame, *more: Column) -> DataFrame:
    """One row: depth, dates of peak, trough and recovery. The trough is the first lowest
    date; the peak the last date up to it at the peak's value; the recovery the first
    later date that regains it, given that at least two do. A curve that never falls, or
    has no rows, has depth 0 and no dates. ``more``: further aggregates of the curve.

    The curve is computed once: values are compared for equality, and sums of doubles differ
    in their last bits from one computation to the next."""
    at = F.when(F.col("drawdown").isNotNull(), F.struct("drawdown", F.col("date").alias("trough_date"), F.col("peak").alias("level")))
    whole = by_calendar().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = drawdowns(equity).withColumn("low", F.min(at).over(whole)).select("date", "equity", F.col("low.drawdown").alias("max_drawdown"), "low.trough_date", "low.level")
    falls = F.col("max_drawdown") < 0
    back = falls & (F.col("date") > F.col("trough_date")) & (F.col("equity") >= F.col("level"))
    return d.agg(
        F.coalesce(F.max("max_drawdown"), F.lit(0.0)).alias("max_drawdown"),
        F.max(F.when(falls, F.col("trough_date"))).alias("trough_date"),
        F.max(F.when(falls & (F.col("date") <= F.col("trough_date")) & (F.col("equity") == F.col("level")), F.col("date"))).alias("peak_date"),
        F.when(F.sum(back.cast("long")) >= 2, F.min(F.when(back, F.col("date")))).alias("recovery_date"),
        *more,
    )


def calmar(cagr_value: Column, depth: Column) -> Column:
    return F.when(F.abs(depth) < 1e-10, 0.0).otherwise(cagr_value / F.nullif(F.abs(depth), F.lit(0.0)))


def rolling_sharpe(returns: DataFrame, n: int = 63, risk_free: float = RISK_FREE) -> DataFrame:
    x = F.col("ret") - risk_free / YEAR
    value = divide(rolling(F.avg, x, n, w=by_calendar()), rolling(F.stddev_samp, x, n, w=by_calendar())) * F.sqrt(F.lit(YEAR))
    return returns.select("date", value.alias("rolling_sharpe"))


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def monthly_returns(returns: DataFrame) -> DataFrame:
    """year x month of compound returns, and the year's."""
    grow = F.product(1 + F.col("ret")) - 1
    by = returns.select(F.year("date").alias("year"), F.date_format("date", "MMM").alias("month"), "ret")
    wide = by.groupBy("year").pivot("month", list(MONTHS)).agg(grow)
    return wide.join(by.groupBy("year").agg(grow.alias("YTD")), "year")


def return_stats(returns: DataFrame, column: str = "ret") -> DataFrame:
    """n, mean, median, deviation, and bias-corrected skewness and excess kurtosis."""
    x = F.col(column)
    s = returns.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6))
    return s.select("n", "mean", "median", "std", skew.alias("skewness"), kurt.alias("kurtosis"))


def histogram(df: DataFrame, column: str = "ret", bins: int = 80) -> DataFrame:
    """(bin, low, high, n): equal bins between the least and the largest value, 1 to ``bins``."""
    bounds = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    x = df.select(column).where(F.col(column).isNotNull()).join(F.broadcast(bounds))  # one row is broadcast
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.least(F.lit(bins), F.floor(F.coalesce(divide(F.col(column) - F.col("_a"), width), F.lit(0.0))) + 1).cast("int")
    out = x.select(k.alias("bin"), "_a", width.alias("_w")).groupBy("bin", "_a", "_w").agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.col("_a") + (F.col("bin") - 1) * F.col("_w")).alias("low"), (F.col("_a") + F.col("bin") * F.col("_w")).alias("high"), "n")


def exit_breakdown(trades: DataFrame, result: str = "pnl_pct") -> DataFrame:
    """Per exit reason: trades, mean gain and loss, share won."""
    x = F.col(result)
    return trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x <= 0, x)).alias("avg_loss"), (F.avg((x > 0).cast("double")) * 100).alias("win_pct"))


def compute_all(equity: DataFrame, trades: DataFrame) -> DataFrame:
    """One row with all metrics of equity(date, total_equity, num_positions) and trades."""
    curve = equity.select("date", F.col("total_equity").alias("equity"), "num_positions")
    r = daily_returns(curve)
    ret = F.col("ret")
    a = curve.agg(total_return().alias("total_return"), cagr().alias("cagr"), exposure().alias("exposure"), F.count("equity").alias("n_trading_days"))
    b = r.agg(F.coalesce(F.stddev_samp(ret) * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("annual_volatility"), sharpe(ret).alias("sharpe_ratio"), sortino(ret).alias("sortino_ratio"))
    d = max_drawdown(curve).select("max_drawdown", F.col("peak_date").alias("max_drawdown_peak_date"), F.col("trough_date").alias("max_drawdown_trough_date"), F.col("recovery_date").alias("max_drawdown_recovery_date"))
    pnl = F.col("pnl")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = trades.agg(
        F.count(F.lit(1)).alias("total_trades"), F.coalesce(F.sum((pnl > 0).cast("long")), F.lit(0)).alias("winning_trades"), F.coalesce(F.sum((pnl < 0).cast("long")), F.lit(0)).alias("losing_trades"),
        win_rate().alias("win_rate"), profit_factor().alias("profit_factor"), zero(F.avg(pnl)).alias("avg_pnl_per_trade"), zero(F.avg(F.when(pnl > 0, pnl))).alias("avg_winning_trade"),
        zero(F.avg(F.when(pnl < 0, pnl))).alias("avg_losing_trade"), avg_holding_days().alias("avg_holding_period_days"),
    )
    one = a.crossJoin(b).crossJoin(d).crossJoin(t)  # one row each
    return one.withColumn("calmar_ratio", calmar(F.col("cagr"), F.col("max_drawdown"))).withColumn("max_drawdown_pct", F.col("max_drawdown"))
