"""Cross-sectional features: the second partitioning, by date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RankingConfig
from ..functions import by_date, by_ticker, at_most, change, divide, min_max, percent_rank_average

#: Component -> (column, whether low values score high).
COMPONENTS = {
    "rsi_score": ("rsi", True),
    "zscore_score": ("zscore", True),
    "relative_weakness_score": ("relative_weakness", True),
    "volume_exhaustion_score": ("volume_exhaustion", False),
    "atr_norm_score": ("atr", True),
    "dist_from_ma_score": ("distance_from_sma_20", True),
}
ZSCORED = ("zscore", "rsi", "distance_from_sma_20", "relative_weakness", "volume_spike")
RANKED = ("zscore", "rsi", "relative_weakness")


def market_returns(index: DataFrame) -> DataFrame:
    """(date, market_ret_5d, market_ret_20d), known at the close of the day before. A
    calendar: one partition."""
    w = Window.orderBy("date")
    r = index.select("date", change(F.col("close"), 5, w).alias("r5"), change(F.col("close"), 20, w).alias("r20"))
    return r.select("date", F.lag("r5", 1).over(w).alias("market_ret_5d"), F.lag("r20", 1).over(w).alias("market_ret_20d"))


def with_relative(df: DataFrame, index: DataFrame, align_lags: bool = False) -> DataFrame:
    """``relative_return_5d`` and ``relative_weakness``: returns over the market's. The
    market leg is a day older than the stock's unless ``align_lags`` lags that too.
    Missing return columns are derived per ticker. The calendar is small; the planner
    broadcasts it by its size."""
    derived = {f"return_{p}d": change(F.col("close"), p) for p in (5, 20) if f"return_{p}d" not in df.columns}
    df = df.withColumns(derived) if derived else df
    leg = {p: F.lag(f"return_{p}d", 1).over(by_ticker()) if align_lags else F.col(f"return_{p}d") for p in (5, 20)}
    df = df.withColumns({f"_leg_{p}": c for p, c in leg.items()}).join(market_returns(index), "date", "left")
    return df.withColumns({"relative_return_5d": F.col("_leg_5") - F.col("market_ret_5d"), "relative_weakness": F.col("_leg_20") - F.col("market_ret_20d")}).drop("_leg_5", "_leg_20")


def cross_zscore(x: Column) -> Column:
    w = by_date()
    return divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def with_cross_zscores(df: DataFrame, columns: tuple[str, ...] = ZSCORED) -> DataFrame:
    return df.withColumns({f"cs_zscore_{c}": cross_zscore(F.col(c)) for c in columns if c in df.columns})


def with_cross_percentiles(df: DataFrame, columns: tuple[str, ...] = RANKED) -> DataFrame:
    return df.withColumns({f"cs_percentile_{c}": percent_rank_average(df, c) for c in columns if c in df.columns})


def with_volume_exhaustion(df: DataFrame) -> DataFrame:
    """Volume spike times the size of the day's fall; null where inputs are not there."""
    if {"volume_spike", "return_1d"} <= set(df.columns):
        return df.withColumn("volume_exhaustion", F.col("volume_spike") * F.abs(at_most(F.col("return_1d"), 0.0)))
    return df.withColumn("volume_exhaustion", F.lit(None).cast("double"))


def with_component_scores(df: DataFrame) -> DataFrame:
    """Each component's place in the day's range; 0.5 where the range is empty."""
    return df.withColumns({s: min_max(F.col(c), by_date(), invert) if c in df.columns else F.lit(None).cast("double") for s, (c, invert) in COMPONENTS.items()})


def with_mean_reversion_score(df: DataFrame, cfg: RankingConfig = RankingConfig(), available: set[str] | None = None) -> DataFrame:
    """Weighted sum of the components that are available, weights made to add up to 1.

    ``available``: by default the components with any value in the whole frame. That is a
    scalar subquery over the frame, which goes where the score is not read; name the
    components to save it."""
    weights = {s: w for s, w in cfg.weights().items() if s in (df.columns if available is None else available)}
    if not weights:
        return df.withColumn("mean_reversion_score", F.lit(None).cast("double"))
    if available is None:
        found = df.agg(F.struct(*[F.max(F.col(s).isNotNull()).alias(s) for s in weights]).alias("found")).scalar()
        used = {s: F.coalesce(found[s], F.lit(False)) for s in weights}
    else:
        used = {s: F.lit(True) for s in weights}
    total = reduce(Column.__add__, [F.when(used[s], w).otherwise(0.0) for s, w in weights.items()])
    score = reduce(Column.__add__, [F.when(used[s], F.col(s) * w).otherwise(0.0) for s, w in weights.items()])
    return df.withColumn("mean_reversion_score", divide(score, total))


def with_all(df: DataFrame, index: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """All features in order; the windows by date share one exchange."""
    df = with_volume_exhaustion(with_relative(df, index))
    return with_mean_reversion_score(with_component_scores(with_cross_percentiles(with_cross_zscores(df))), cfg)


def winsorised(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``column`` clipped to its percentiles (linear interpolation) over all rows."""
    bounds = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_p"))
    df = df.join(F.broadcast(bounds))  # one row is broadcast
    x = F.col(column)
    return df.withColumn(column, F.when(x.isNotNull(), F.greatest(F.col("_p")[0], F.least(F.col("_p")[1], x)))).drop("_p")


def normalised(df: DataFrame, column: str) -> DataFrame:
    """``column`` between its least (0) and largest (1) value; null if they are equal."""
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    df = df.join(F.broadcast(bounds))  # one row is broadcast
    return df.withColumn(column, divide(F.col(column) - F.col("_low"), F.col("_high") - F.col("_low"))).drop("_low", "_high")


def pivoted(df: DataFrame, value: str = "close", tickers: list[str] | None = None) -> DataFrame:
    """date x ticker, means of ``value``."""
    g = df.groupBy("date")
    return (g.pivot("ticker", tickers) if tickers else g.pivot("ticker")).agg(F.avg(value))
