"""The registered queries of the bar operators, each over whole tables.

Results are rounded so that they compare with the SQL in ``oracle``: Spark and DuckDB add
doubles in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import business_days, change, parse_date
from ..operators import clean, features, indicators, metrics, ranking, regime, signals, simulate, trades, walk_forward
from ..sources import panels
from ..sources.files import safe_filename_column, ticker_of_path
from ..streaming import bars as tick_bars
from . import research

CFG = Config()
#: Where ``universe_diff`` divides the line items.
HALF = "1998-06-05"
#: See ``rounded``.
NUDGE = 1.3e-7
COSTS = (0.0, 0.001, 0.002, 0.003)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded (negative zero as zero), after a small offset that moves exact decimal
    halves, which the two engines round differently; integers as long."""
    fix = {}
    for c, kind in df.dtypes:
        if kind == "double":
            fix[c] = F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            fix[c] = F.col(c).cast("long")
    return df.withColumns(fix)


def bars(spark: SparkSession, d: str) -> DataFrame:
    return panels.bars_daily(spark, d)


def index(spark: SparkSession, d: str) -> DataFrame:
    return panels.index_daily(bars(spark, d))


def panel(spark: SparkSession, d: str) -> research.Research:
    return research.research(bars(spark, d), index(spark, d), panels.vix_daily(spark, d), CFG)


def key(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select("ticker", "date", *columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# ----------------------------------------------------------------------------- panels


@query
def bars_daily(spark, d):  # noqa: ANN001, ANN201
    return rounded(bars(spark, d))


@query
def bars_hourly(spark, d):  # noqa: ANN001, ANN201
    return rounded(panels.bars_hourly(spark, d))


@query
def index_daily(spark, d):  # noqa: ANN001, ANN201
    return rounded(index(spark, d))


@query
def vix_daily(spark, d):  # noqa: ANN001, ANN201
    return rounded(panels.vix_daily(spark, d))


# --------------------------------------------------------------------------- cleaning


@query
def clean_ffill(spark, d):  # noqa: ANN001, ANN201
    return rounded(clean.fill_gaps(panels.bars_gapped(spark, d), CFG.data.ffill_limit))


@query
def clean_validate(spark, d):  # noqa: ANN001, ANN201
    return rounded(panels.bars_gapped(spark, d).where(F.coalesce(clean.is_valid(), F.lit(False))))


@query
def clean_stats(spark, d):  # noqa: ANN001, ANN201
    return rounded(clean.cleaning_stats(panels.bars_gapped(spark, d), CFG.data))


@query
def clean_quality_gate(spark, d):  # noqa: ANN001, ANN201
    return rounded(clean.clean(panels.bars_gapped(spark, d), CFG.data))


@query
def clean_report(spark, d):  # noqa: ANN001, ANN201
    return rounded(clean.cleaning_report(clean.cleaning_stats(panels.bars_gapped(spark, d), CFG.data)))


@query
def null_shares(spark, d):  # noqa: ANN001, ANN201
    return rounded(clean.null_shares(panels.bars_gapped(spark, d)))


@query
def file_names(spark, d):  # noqa: ANN001, ANN201
    t = bars(spark, d).select("ticker").distinct().select(F.concat("ticker", F.lit("&/x")).alias("ticker"))
    name = F.concat(safe_filename_column(F.col("ticker")), F.lit(".csv"))
    return t.select("ticker", name.alias("file_name"), ticker_of_path(F.concat(F.lit("/raw/"), name)).alias("back"))


# ------------------------------------------------------------------------- indicators


@query
def sma(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumns({f"sma_{p}": indicators.sma(F.col("close"), p) for p in CFG.indicators.sma_periods}), *[f"sma_{p}" for p in CFG.indicators.sma_periods])


@query
def bollinger(spark, d):  # noqa: ANN001, ANN201
    up, mid, low = indicators.bollinger(F.col("close"))
    df = bars(spark, d).withColumns({"bb_upper": up, "bb_middle": mid, "bb_lower": low})
    return key(df.withColumn("bb_pct_b", indicators.pct_b(F.col("close"), F.col("bb_upper"), F.col("bb_lower"))), "bb_upper", "bb_middle", "bb_lower", "bb_pct_b")


@query
def returns(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumns({f"return_{p}d": change(F.col("close"), p) for p in (1, 5, 10, 20)}), *[f"return_{p}d" for p in (1, 5, 10, 20)])


@query
def volatility(spark, d):  # noqa: ANN001, ANN201
    df = bars(spark, d).withColumn("r", indicators.log_return(F.col("close")))
    return key(df.withColumn("volatility_ann", indicators.volatility(F.col("r"))), "volatility_ann")


@query
def zscore(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumn("zscore", indicators.zscore(F.col("close"))), "zscore")


@query
def volume_spike(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumn("volume_spike", indicators.volume_spike(F.col("volume"))), "volume_spike")


@query
def dist_ma(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumn("dist_from_ma_20", indicators.distance_from_ma(F.col("close"))), "dist_from_ma_20")


@query
def range_pct(spark, d):  # noqa: ANN001, ANN201
    return key(bars(spark, d).withColumn("percentile_rank_252", indicators.range_position(F.col("close"))), "percentile_rank_252")


@query
def rsi(spark, d):  # noqa: ANN001, ANN201
    return key(indicators.with_rsi(bars(spark, d), 2), "rsi_2")


@query
def ema(spark, d):  # noqa: ANN001, ANN201
    return key(indicators.with_ema(bars(spark, d)), "ema_9", "ema_21", "ema_50")


@query
def atr(spark, d):  # noqa: ANN001, ANN201
    return key(indicators.with_atr(bars(spark, d)), "atr_14")


@query
def indicators_all(spark, d):  # noqa: ANN001, ANN201
    df = indicators.with_all(bars(spark, d))
    return rounded(df.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), *[F.avg(c).alias(c) for c in df.columns if c not in ("ticker", "date")]))


@query
def annualised(spark, d):  # noqa: ANN001, ANN201
    r = bars(spark, d).withColumn("r", change(F.col("close"), 1) / 1000)
    return rounded(r.groupBy("ticker").agg(indicators.annualised_return(F.col("r")).alias("annual_return"), indicators.annualised_volatility(F.col("r")).alias("annual_volatility")))


# --------------------------------------------------------------------------- features


def featured(spark, d):  # noqa: ANN001, ANN201
    return features.with_all(indicators.with_all(bars(spark, d)), index(spark, d))


@query
def relative_features(spark, d):  # noqa: ANN001, ANN201
    return key(features.with_relative(bars(spark, d), index(spark, d)), "market_ret_5d", "market_ret_20d", "relative_return_5d", "relative_weakness")


@query
def cs_zscore(spark, d):  # noqa: ANN001, ANN201
    df = bars(spark, d).withColumns({"zscore": indicators.zscore(F.col("close")), "volume_spike": indicators.volume_spike(F.col("volume"))})
    return key(features.with_cross_zscores(df), "cs_zscore_zscore", "cs_zscore_volume_spike")


@query
def cs_percentile(spark, d):  # noqa: ANN001, ANN201
    df = bars(spark, d).withColumn("zscore", indicators.zscore(F.col("close")))
    return key(features.with_cross_percentiles(df), "cs_percentile_zscore")


@query
def volume_exhaustion(spark, d):  # noqa: ANN001, ANN201
    df = bars(spark, d).withColumns({"return_1d": change(F.col("close"), 1), "volume_spike": indicators.volume_spike(F.col("volume"))})
    return key(features.with_volume_exhaustion(df), "volume_exhaustion")


@query
def component_scores(spark, d):  # noqa: ANN001, ANN201
    return key(featured(spark, d), *features.COMPONENTS)


@query
def mean_reversion_score(spark, d):  # noqa: ANN001, ANN201
    return key(featured(spark, d), "mean_reversion_score")


@query
def winsorize(spark, d):  # noqa: ANN001, ANN201
    return key(features.winsorised(bars(spark, d), "close"), "close")


@query
def minmax(spark, d):  # noqa: ANN001, ANN201
    return key(features.normalised(bars(spark, d), "close"), "close")


@query
def pivot_close(spark, d):  # noqa: ANN001, ANN201
    return rounded(features.pivoted(bars(spark, d)))


# ----------------------------------------------------------------------------- regime


@query
def regime_raw(spark, d):  # noqa: ANN001, ANN201
    return regime.regimes(index(spark, d), panels.vix_daily(spark, d)).select("date", "raw_regime")


@query
def regime_confirmed(spark, d):  # noqa: ANN001, ANN201
    r = regime.regimes(index(spark, d), panels.vix_daily(spark, d))
    return rounded(r.select("date", "regime", regime.strength(F.col("regime")).alias("strength"), regime.trading_allowed(F.col("regime")).alias("allowed")))


@query
def regime_vix_asof(spark, d):  # noqa: ANN001, ANN201
    return regime.vix_low(index(spark, d), panels.vix_daily(spark, d)).select("date", "low_vol")


@query
def regime_realised(spark, d):  # noqa: ANN001, ANN201
    return regime.low_volatility(index(spark, d), None).select("date", "low_vol")


@query
def regime_distribution(spark, d):  # noqa: ANN001, ANN201
    return rounded(regime.distribution(regime.regimes(index(spark, d), panels.vix_daily(spark, d))))


@query
def regime_segments(spark, d):  # noqa: ANN001, ANN201
    return rounded(regime.segments(regime.regimes(index(spark, d), panels.vix_daily(spark, d))))


# ------------------------------------------------------------------ signals and ranks


@query
def buy_signals(spark, d):  # noqa: ANN001, ANN201
    s = panel(spark, d).signals
    return rounded(s.select("ticker", "date", "conditions_count", "buy_signal", "signal_strength", "buy_conditions_met"), 3)


@query
def exit_signals(spark, d):  # noqa: ANN001, ANN201
    df = indicators.with_rsi(bars(spark, d).withColumn("zscore", indicators.zscore(F.col("close"))), 2).withColumnRenamed("rsi_2", "rsi")
    return signals.with_exits(df).select("ticker", "date", "sell_signal", "exit_reason")


@query
def signal_frequency(spark, d):  # noqa: ANN001, ANN201
    return rounded(signals.frequency(panel(spark, d).signals))


@query
def rank_candidates(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel(spark, d).rankings.select("date", "rank", "ticker", "composite_score"), 3)


@query
def top_candidates(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.top(panel(spark, d).rankings, 5).select("date", "rank", "ticker", "composite_score"), 3)


@query
def latest_per_ticker(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.latest(bars(spark, d)))


@query
def most_stretched(spark, d):  # noqa: ANN001, ANN201
    return rounded(research.latest_stretched(bars(spark, d)))


@query
def universe_diff(spark, d):  # noqa: ANN001, ANN201
    """What was traded before and from the middle of the ship dates on: every line item is
    in one of the two universes."""
    symbol = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_size").cast("string")).alias("symbol")
    early = (F.col("l_shipdate").cast("date") < F.lit(HALF).cast("date")).alias("early")
    traded = panels.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), early).distinct().join(panels.table(spark, d, "part"), "p_partkey")
    return ranking.universe_difference(*(traded.where(c).select(symbol) for c in ("early", "not early")))


@query
def ticker_counts(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.row_counts(bars(spark, d)))


@query
def trading_calendar(spark, d):  # noqa: ANN001, ANN201
    return rounded(ranking.calendar(bars(spark, d)))


@query
def business_day_counts(spark, d):  # noqa: ANN001, ANN201
    o = panels.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    return rounded(o.select("o_orderkey", "a", business_days(F.col("a"), F.date_add("a", (F.col("o_orderkey") % 40).cast("int"))).alias("days")))


@query
def parsed_dates(spark, d):  # noqa: ANN001, ANN201
    o = panels.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text"))
    return o.select("o_orderkey", parse_date(F.col("text")).alias("date"))


# -------------------------------------------------------------------- trades, metrics


@query
def trades_uncoupled(spark, d):  # noqa: ANN001, ANN201
    return rounded(trades.uncoupled_trades(panel(spark, d).signals), 3)


def _equity(spark, d):  # noqa: ANN001, ANN202
    return index(spark, d).select("date", F.col("close").alias("equity"))


def _one(spark, d):  # noqa: ANN001, ANN202
    return metrics.daily_returns(_equity(spark, d))


@query
def cagr(spark, d):  # noqa: ANN001, ANN201
    return rounded(_equity(spark, d).agg(metrics.cagr().alias("cagr"), metrics.total_return().alias("total_return")))


@query
def sharpe(spark, d):  # noqa: ANN001, ANN201
    return rounded(_one(spark, d).agg(metrics.sharpe(F.col("ret")).alias("sharpe"), metrics.sortino(F.col("ret")).alias("sortino")))


@query
def drawdown(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.drawdowns(_equity(spark, d)).select("date", "drawdown"))


@query
def max_drawdown(spark, d):  # noqa: ANN001, ANN201
    m = metrics.max_drawdown(_equity(spark, d), metrics.cagr().alias("cagr"))
    return rounded(m.withColumn("calmar", metrics.calmar(F.col("cagr"), F.col("max_drawdown"))).drop("cagr"))


@query
def rolling_sharpe(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.rolling_sharpe(_one(spark, d)))


@query
def monthly_returns(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.monthly_returns(_one(spark, d)))


@query
def return_stats(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.return_stats(_one(spark, d)))


@query
def return_histogram(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.histogram(_one(spark, d)))


@query
def benchmark_equity(spark, d):  # noqa: ANN001, ANN201
    return rounded(simulate.benchmark_equity(index(spark, d)), 2)


@query
def trade_metrics(spark, d):  # noqa: ANN001, ANN201
    t = trades.uncoupled_trades(panel(spark, d).signals).where("exit_date is not null").withColumn("pnl", F.col("pnl_pct"))
    return rounded(t.agg(metrics.win_rate().alias("win_rate"), metrics.profit_factor().alias("profit_factor"), metrics.avg_holding_days().alias("avg_holding_days")))


@query
def exit_breakdown(spark, d):  # noqa: ANN001, ANN201
    return rounded(metrics.exit_breakdown(trades.uncoupled_trades(panel(spark, d).signals).where("exit_date is not null")))


# ------------------------------------------------------------------------- simulation


def calm(spark, d, once=lambda df: df):  # noqa: ANN001, ANN202
    """The panel with damped prices: undamped ones jump a hundredfold from day to day.
    ``once`` is applied to its three tables, which the plan reads many times."""
    b = bars(spark, d)
    b = once(b.withColumns({c: 100 * F.pow(c, F.lit(0.02)) for c in ("open", "high", "low", "close")}))
    return research.research(b, once(panels.index_daily(b)), once(panels.vix_daily(spark, d)), CFG)


def _days(spark, d):  # noqa: ANN001, ANN202
    r = calm(spark, d)
    return simulate.days_of(r.signals, r.rankings, r.regime)


@query
def portfolio_trades(spark, d):  # noqa: ANN001, ANN201
    return simulate.simulated_trades(_days(spark, d), simulate.scenarios(spark))


@query
def portfolio_equity(spark, d):  # noqa: ANN001, ANN201
    return simulate.simulated_equity(_days(spark, d), simulate.scenarios(spark))


@query
def cost_sensitivity(spark, d):  # noqa: ANN001, ANN201
    which, days = simulate.scenarios(spark, costs=COSTS), _days(spark, d)
    return simulate.summary_of(simulate.simulated(days, which))


@query
def portfolio_metrics(spark, d):  # noqa: ANN001, ANN201
    return research.backtest(calm(spark, d, research.settled), CFG).metrics


# ----------------------------------------------------------------------- walk-forward


def _walk(spark, d):  # noqa: ANN001, ANN202
    df = indicators.with_rsi(bars(spark, d).withColumn("zscore", indicators.zscore(F.col("close"))), 2).withColumnRenamed("rsi_2", "rsi")
    return df, walk_forward.grid(spark, CFG.walk_forward.grid), walk_forward.windows(ranking.calendar(df), CFG.walk_forward)


@query
def wfo_windows(spark, d):  # noqa: ANN001, ANN201
    return rounded(_walk(spark, d)[2])


@query
def wfo_grid(spark, d):  # noqa: ANN001, ANN201
    return rounded(walk_forward.grid(spark, CFG.walk_forward.grid))


@query
def wfo_insample(spark, d):  # noqa: ANN001, ANN201
    return rounded(walk_forward.in_sample(*_walk(spark, d)))


@query
def wfo_best(spark, d):  # noqa: ANN001, ANN201
    return rounded(walk_forward.best(walk_forward.in_sample(*_walk(spark, d))))


@query
def wfo_oos(spark, d):  # noqa: ANN001, ANN201
    w = _walk(spark, d)
    return rounded(walk_forward.out_of_sample(*w, walk_forward.best(walk_forward.in_sample(*w))), 6)


@query
def wfo_summary(spark, d):  # noqa: ANN001, ANN201
    w = _walk(spark, d)
    chosen = walk_forward.best(walk_forward.in_sample(*w))
    total = F.log10(1 + F.col("oos_total_return"))  # made-up prices compound far beyond rounding
    return rounded(walk_forward.summary(chosen, walk_forward.out_of_sample(*w, chosen)).withColumn("oos_total_return", total))


@query
def stream_hourly_bars(spark, d):  # noqa: ANN001, ANN201
    e = panels.table(spark, d, "events").select(F.col("event_type").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return rounded(tick_bars(e))


def entry(spark: SparkSession, d: str) -> DataFrame:
    return most_stretched(spark, d)


__all__ = ["QUERIES", "Window", "entry"]
