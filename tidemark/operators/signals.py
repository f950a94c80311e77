"""Entry and exit signals: columns of the feature panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RegimeConfig, SignalConfig
from ..functions import holds, rolling

CONDITIONS = ("rsi_oversold", "zscore_low", "below_bb_lower", "relative_weakness", "volume_spike", "regime_ok", "atr_ok")


def with_regime(df: DataFrame, regime: DataFrame) -> DataFrame:
    """``regime`` by date, 'unknown' where there is none."""
    df = df.drop("regime").join(regime.select("date", "regime"), "date", "left")
    return df.withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def conditions(df: DataFrame, cfg: SignalConfig = SignalConfig(), regime: RegimeConfig = RegimeConfig()) -> dict[str, Column]:
    """The seven entry predicates; false where null, false (the last: true) where a column is missing."""

    def when(column: str, test: Column, missing: bool = False) -> Column:
        return holds(test) if column in df.columns else F.lit(missing)

    median = rolling(lambda x: F.percentile(x, F.lit(0.5)), F.col("atr"), cfg.atr_median_lookback, cfg.atr_median_min)
    tests = (
        when("rsi", F.col("rsi") < cfg.rsi_buy),
        when("zscore", F.col("zscore") < cfg.zscore_buy),
        when("bb_lower", F.col("close") < F.col("bb_lower")),
        when("relative_weakness", F.col("relative_weakness") < cfg.relative_weakness_buy),
        when("volume_spike", F.col("volume_spike") > cfg.volume_spike_buy),
        when("regime", F.col("regime").isin(*regime.allowed)),
        when("atr", F.col("atr") < cfg.atr_multiple * median, True),
    )
    return dict(zip(CONDITIONS, tests, strict=True))


def with_entries(df: DataFrame, cfg: SignalConfig = SignalConfig(), regime: RegimeConfig = RegimeConfig()) -> DataFrame:
    """conditions_count, buy_signal, signal_strength (0 to 100), buy_conditions_met."""
    tests = conditions(df, cfg, regime)
    names = {f"_c_{n}": c for n, c in tests.items()}
    df = df.withColumns(names)
    count = reduce(Column.__add__, [F.col(n).cast("int") for n in names])
    df = df.withColumn("conditions_count", count).withColumn("buy_signal", F.col("conditions_count") >= cfg.min_conditions)
    z = F.least(F.abs(F.least(F.col("zscore"), F.lit(0.0))), F.lit(3.0)) / 3 * 10 if "zscore" in df.columns else F.lit(0.0)
    r = F.greatest(F.lit(0.0), F.least(F.lit(10.0), cfg.rsi_buy - F.col("rsi"))) / 10 * 10 if "rsi" in df.columns else F.lit(0.0)
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("zscore", "rsi") if c in df.columns], F.lit(True))
    strength = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("conditions_count") / len(CONDITIONS) * 100 + z + r))
    met = F.concat_ws(",", *[F.when(F.col(f"_c_{n}"), n) for n in tests])
    return df.withColumns({"signal_strength": F.when(~F.col("buy_signal"), F.lit(0.0)).when(known, strength), "buy_conditions_met": met}).drop(*names)


def with_exits(df: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """sell_signal and its reason, the first that holds, else ''."""
    reversion = holds(F.col("zscore") > cfg.zscore_exit) if "zscore" in df.columns else F.lit(False)
    hot = holds(F.col("rsi") > cfg.rsi_exit) if "rsi" in df.columns else F.lit(False)
    return df.withColumns({"sell_signal": reversion | hot, "exit_reason": F.when(reversion, "mean_reversion").when(hot, "rsi_exit").otherwise("")})


def with_all(df: DataFrame, regime: DataFrame, cfg: SignalConfig = SignalConfig(), rules: RegimeConfig = RegimeConfig()) -> DataFrame:
    return with_exits(with_entries(with_regime(df, regime), cfg, rules), cfg)


def frequency(signals: DataFrame) -> DataFrame:
    """Number of entry signals per date."""
    return signals.groupBy("date").agg(F.sum(F.col("buy_signal").cast("long")).alias("buy_signals"), F.count(F.lit(1)).alias("tickers"))
