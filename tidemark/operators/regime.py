"""Market regime of an index with hysteresis. Index tables are calendars (thousands of
rows): their windows have no partition key and run in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRADING_DAYS, RegimeConfig
from ..functions import as_of, by_calendar, divide, holds, rolling, run_lengths

LABELS = ("bearish", "cautious", "mild_bull", "strong_bull")


def averages(index: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Lagged slow and fast means, the close before, and the buffer band."""
    c = F.col("close")
    df = index.select("date", "close").withColumns(
        {"sma_slow": rolling(F.avg, c, cfg.ma_period, w=by_calendar(), shift=1), "sma_fast": rolling(F.avg, c, cfg.fast_ma_period, w=by_calendar(), shift=1), "prev_close": F.lag(c, 1).over(by_calendar())}
    )
    return df.withColumns({"upper_band": F.col("sma_slow") * (1 + cfg.buffer), "lower_band": F.col("sma_slow") * (1 - cfg.buffer)})


def _below_quantile(x: Column, cfg: RegimeConfig) -> Column:
    """Whether the value before is under the percentile of the values before."""
    bound = rolling(lambda v: F.percentile(v, F.lit(cfg.vol_percentile)), x, cfg.rv_benchmark, cfg.rv_benchmark_min, by_calendar(), shift=1)
    return F.lag(x, 1).over(by_calendar()) < bound


def vix_low(index: DataFrame, vix: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """(date, low_vol): volatility index below its own percentile, as of each index date."""
    flag = vix.select("date", holds(_below_quantile(F.col("close"), cfg)).alias("low_vol"))
    return as_of(index.select("date"), flag, "low_vol").withColumn("low_vol", holds(F.col("low_vol")))


def realised_low(index: DataFrame, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """The same from the index's own realised volatility."""
    df = index.select("date", F.ln(divide(F.col("close"), F.lag("close", 1).over(by_calendar()))).alias("r"))
    df = df.withColumn("rv", rolling(F.stddev_samp, F.col("r"), cfg.rv_lookback, w=by_calendar()) * F.sqrt(F.lit(float(TRADING_DAYS))))
    return df.select("date", holds(_below_quantile(F.col("rv"), cfg)).alias("low_vol"))


def low_volatility(index: DataFrame, vix: DataFrame | None, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    return realised_low(index, cfg) if vix is None or vix.isEmpty() else vix_low(index, vix, cfg)


def classified(df: DataFrame) -> DataFrame:
    """``raw_regime`` from averages and ``low_vol``; inside the band the last label stays."""
    above, below = holds(F.col("prev_close") > F.col("upper_band")), holds(F.col("prev_close") < F.col("lower_band"))
    rising = holds(F.col("sma_fast") > F.col("sma_slow"))
    label = (
        F.when(above & rising & holds(F.col("low_vol")), "strong_bull")
        .when(above, "mild_bull")
        .when(below & rising, "cautious")
        .when(below, "bearish")
    )
    return df.withColumn("raw_regime", F.last(label, True).over(by_calendar().rowsBetween(Window.unboundedPreceding, 0)))


def confirmed(df: DataFrame, days: int = 3) -> DataFrame:
    """``regime``: the raw label once it has held for ``days`` days, else the one before.

    If the first row has a label already, it is confirmed at once and counts twice."""
    if days <= 1:
        return df.withColumn("regime", F.col("raw_regime"))
    df = run_lengths(df, "raw_regime", by_calendar())
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("date"))
    first = F.first("raw_regime").over(by_calendar().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_first": first, "_k": place})
    k = F.col("_k") + F.when(F.col("_first").isNotNull() & (F.col("run_id") == 1), 1).otherwise(0)
    kept = F.last(F.when((k >= days) & F.col("raw_regime").isNotNull(), F.col("raw_regime")), True)
    return df.withColumn("regime", F.coalesce(kept.over(by_calendar().rowsBetween(Window.unboundedPreceding, 0)), "_first")).drop("_first", "_k", "run_id")


def regimes(index: DataFrame, vix: DataFrame | None = None, cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """(date, close, raw_regime, regime) of every index date."""
    df = averages(index, cfg).join(low_volatility(index, vix, cfg), "date", "left")
    return confirmed(classified(df), cfg.confirm_days).select("date", "close", "raw_regime", "regime")


def trading_allowed(regime: Column, cfg: RegimeConfig = RegimeConfig()) -> Column:
    return holds(regime.isin(*cfg.allowed))


def strength(regime: Column) -> Column:
    out = F.when(regime == LABELS[0], F.lit(0.0))
    for i, label in enumerate(LABELS[1:], 1):
        out = out.when(regime == label, F.lit(i / 3))
    return out


def distribution(regime: DataFrame) -> DataFrame:
    n = regime.groupBy("regime").agg(F.count(F.lit(1)).alias("days"))
    return n.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy(F.lit(1))))


def segments(regime: DataFrame) -> DataFrame:
    """Contiguous runs of a label with their first and last dates."""
    df = run_lengths(regime, "regime", by_calendar())
    return df.groupBy("run_id", "regime").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("days"))
