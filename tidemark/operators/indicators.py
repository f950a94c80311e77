"""Technical indicators per ticker. All share the window (ticker, date), so one exchange and sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRADING_DAYS, IndicatorConfig
from ..functions import by_ticker, at_least, change, divide, rolling, trailing
from ..functions.ewm import ewm
from .clean import require_columns


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def bollinger(x: Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle and lower band: mean and k population deviations."""
    middle, spread = rolling(F.avg, x, n), rolling(F.stddev_pop, x, n)
    return middle + k * spread, middle, middle - k * spread


def pct_b(x: Column, upper: Column, lower: Column) -> Column:
    return divide(x - lower, upper - lower)


def volatility(log_return: Column, n: int = 20) -> Column:
    """Annualised sample deviation of log returns (a column of ``log_returns``)."""
    return rolling(F.stddev_samp, log_return, n) * F.sqrt(F.lit(float(TRADING_DAYS)))


def log_return(x: Column) -> Column:
    return F.ln(divide(x, F.lag(x, 1).over(by_ticker())))


def zscore(x: Column, n: int = 20) -> Column:
    """Distance from the mean of the n bars before, in their sample deviations."""
    return divide(x - rolling(F.avg, x, n, shift=1), rolling(F.stddev_samp, x, n, shift=1))


def volume_spike(volume: Column, n: int = 20) -> Column:
    return divide(volume, rolling(F.avg, volume, n))


def distance_from_ma(x: Column, n: int = 20) -> Column:
    mean = sma(x, n)
    return divide(x - mean, mean)


def range_position(x: Column, n: int = 252) -> Column:
    """Place between the least and the largest of the last n bars, 0 to 100."""
    low, high = rolling(F.min, x, n), rolling(F.max, x, n)
    return divide(x - low, high - low) * 100


def true_range() -> Column:
    before = F.lag("close", 1).over(by_ticker())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _with_steps(df: DataFrame, column: str) -> DataFrame:
    step = F.col(column) - F.lag(column, 1).over(by_ticker())
    return df.withColumns({"_gain": at_least(step, 0.0), "_loss": at_least(-step, 0.0)})


def _rsi_sources(period: int) -> dict[str, tuple[str, float, int]]:
    return {"_mean_gain": ("_gain", 1 / period, period), "_mean_loss": ("_loss", 1 / period, period)}


def _with_rsi(df: DataFrame, name: str) -> DataFrame:
    rs = divide(F.col("_mean_gain"), F.col("_mean_loss"))
    return df.withColumn(name, F.when(F.col("_mean_loss").isNotNull(), F.coalesce(100 - 100 / (1 + rs), F.lit(100.0)))).drop("_gain", "_loss", "_mean_gain", "_mean_loss")


def _ema_sources(periods: tuple[int, ...], column: str) -> dict[str, tuple[str, float, int]]:
    return {f"ema_{p}": (column, 2 / (p + 1), p) for p in periods}


def _atr_sources(period: int) -> dict[str, tuple[str, float, int]]:
    return {f"atr_{period}": ("_range", 1 / period, period)}


def with_rsi(df: DataFrame, period: int = 2, column: str = "close", name: str | None = None) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss); 100 where there was no loss."""
    return _with_rsi(ewm(_with_steps(df, column), _rsi_sources(period)), name or f"rsi_{period}")


def with_ema(df: DataFrame, periods: tuple[int, ...] = (9, 21, 50), column: str = "close") -> DataFrame:
    return ewm(df, _ema_sources(periods, column))


def with_atr(df: DataFrame, period: int = 14) -> DataFrame:
    return ewm(df.withColumn("_range", true_range()), _atr_sources(period)).drop("_range")


def with_all(df: DataFrame, cfg: IndicatorConfig = IndicatorConfig(), strict: bool = False) -> DataFrame:
    """All indicators of dense bars; unless ``strict`` also the names that features and
    signals read: rsi, atr, distance_from_sma_20."""
    require_columns(df)
    c, v = F.col("close"), F.col("volume")
    upper, middle, lower = bollinger(c, cfg.bb_period, cfg.bb_std)
    df = df.withColumns(
        {
            **{f"sma_{p}": sma(c, p) for p in cfg.sma_periods},
            "bb_upper": upper,
            "bb_middle": middle,
            "bb_lower": lower,
            **{f"return_{p}d": change(c, p) for p in cfg.return_periods},
            "_log_return": log_return(c),
            "zscore": zscore(c, cfg.zscore_lookback),
            "volume_spike": volume_spike(v, cfg.volume_ma_period),
            f"dist_from_ma_{cfg.zscore_lookback}": distance_from_ma(c, cfg.zscore_lookback),
            f"percentile_rank_{cfg.percentile_lookback}": range_position(c, cfg.percentile_lookback),
        }
    )
    df = df.withColumns({"bb_pct_b": pct_b(c, F.col("bb_upper"), F.col("bb_lower")), "volatility_ann": volatility(F.col("_log_return"), cfg.volatility_lookback)}).drop("_log_return")
    means = {**_rsi_sources(cfg.rsi_period), **_ema_sources(cfg.ema_periods, "close"), **_atr_sources(cfg.atr_period)}
    df = ewm(_with_steps(df, "close").withColumn("_range", true_range()), means).drop("_range")
    df = _with_rsi(df, f"rsi_{cfg.rsi_period}")
    if strict:
        return df
    return df.withColumns({"rsi": F.col(f"rsi_{cfg.rsi_period}"), "atr": F.col(f"atr_{cfg.atr_period}"), "distance_from_sma_20": F.col(f"dist_from_ma_{cfg.zscore_lookback}")})


def annualised_return(r: Column, periods: int = TRADING_DAYS) -> Column:
    """Aggregate: compound growth of periodic returns per year; 0 for none."""
    n = F.count(r)
    return F.when(n == 0, 0.0).otherwise(F.pow(F.product(1 + r), F.lit(float(periods)) / F.nullif(n, F.lit(0))) - 1)


def annualised_volatility(r: Column, periods: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(periods)))


__all__ = [n for n in dir() if not n.startswith("_")] + ["trailing"]
