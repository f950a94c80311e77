"""Walk-forward optimisation as one relational plan: windows x parameters x entries."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TRADING_DAYS, BacktestConfig, WalkForwardConfig
from .metrics import sharpe, sortino
from .ranking import calendar

#: Candidates that a signal day takes, in order of ticker.
PICKS = 5


def windows(days: DataFrame, cfg: WalkForwardConfig = WalkForwardConfig()) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end) as date indexes, ends
    exclusive; none if there are fewer dates than one window."""
    span = cfg.in_sample + cfg.out_of_sample
    n = days.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= span)
    start = n.select(F.posexplode(F.sequence(F.lit(0), (F.col("n") - span).cast("int"), F.lit(cfg.step))).alias("window_id", "train_start"))
    end = F.col("train_start") + cfg.in_sample
    return start.select("window_id", "train_start", end.alias("train_end"), end.alias("test_start"), (end + cfg.out_of_sample).alias("test_end"))


def grid(spark: SparkSession, spec: dict[str, tuple[float, ...]]) -> DataFrame:
    """(grid_pos, one column per parameter): the product in the order of the keys."""
    rows = [(i, *map(float, p)) for i, p in enumerate(product(*spec.values()))]
    return spark.createDataFrame(rows, ", ".join(["grid_pos int", *[f"{k} double" for k in spec]]))


def entries(panel: DataFrame, params: DataFrame) -> DataFrame:
    """(date_idx, grid_pos, hold, ret): mean forward return of a date's picks.

    Entries depend on the thresholds and the holding days alone. A panel row meets the
    grid (a stated, small table) once; later joins are by equality on the date index."""
    days = calendar(panel)
    p = panel.select("ticker", "date", "close", "rsi", "zscore").join(days.select("date", "date_idx"), "date").drop("date")
    hit = p.crossJoin(F.broadcast(params)).where((F.col("rsi") < F.col("rsi_buy_threshold")) & (F.col("zscore") < F.col("zscore_buy_threshold")))
    place = F.row_number().over(Window.partitionBy("grid_pos", "date_idx").orderBy("ticker"))
    hit = hit.withColumn("_k", place).where(F.col("_k") <= PICKS).withColumn("exit_idx", F.col("date_idx") + F.col("max_holding_days").cast("int"))
    later = p.select("ticker", F.col("date_idx").alias("exit_idx"), F.col("close").alias("exit_close"))
    hit = hit.join(later, ["ticker", "exit_idx"])
    return hit.groupBy("grid_pos", "date_idx", F.col("max_holding_days").cast("int").alias("hold")).agg(F.avg(F.col("exit_close") / F.col("close") - 1).alias("ret"))


def returns(panel: DataFrame, params: DataFrame, spans: DataFrame, costs: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(window_id, grid_pos, date_idx, ret) of every date of spans(window_id, s, e).

    An entry's return is spread over its holding days; dates on which several entries
    overlap average them, dates with none have 0; a tenth of the round-trip cost is taken
    off every day. Entries whose exit would fall beyond the span do not count."""
    e = entries(panel, params)
    inside = e.join(F.broadcast(spans), (F.col("date_idx") >= F.col("s")) & (F.col("date_idx") + F.col("hold") < F.col("e")))  # spans: a row per window
    spread = inside.withColumn("date_idx", F.explode(F.sequence(F.col("date_idx"), F.col("date_idx") + F.col("hold") - 1)))
    by_date = spread.groupBy("window_id", "grid_pos", "date_idx").agg(F.avg(F.col("ret") / F.col("hold")).alias("ret"))
    every = spans.crossJoin(F.broadcast(params.select("grid_pos"))).select("window_id", "grid_pos", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("date_idx"))
    cost = (costs.buy_cost + costs.sell_cost) / 10
    return every.join(by_date, ["window_id", "grid_pos", "date_idx"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)) - cost)


def concatenated_returns(panel: DataFrame, params: DataFrame, spans: DataFrame, costs: BacktestConfig = BacktestConfig()) -> DataFrame:
    """The strict form of ``returns``: every date but the last ``max_holding_days`` adds one
    0 or, with an entry, the entry's spread return once for each holding day, one after the
    other, and the n-th value counts for the span's n-th date. Where that gives more values
    than dates the series is undefined: every date has a null."""
    near = Window.partitionBy("window_id", "grid_pos").orderBy("date_idx").rowsBetween(Window.unboundedPreceding, -1)
    hold, n = F.col("hold"), F.col("e") - F.col("s")
    inside = entries(panel, params).join(F.broadcast(spans), (F.col("date_idx") >= F.col("s")) & (F.col("date_idx") + hold < F.col("e")))  # spans: a row per window
    first = F.col("date_idx") - F.col("s") + F.count(F.lit(1)).over(near) * (hold - 1)
    taken = inside.withColumn("first", first)
    counts = taken.groupBy("window_id", "grid_pos").agg(F.count(F.lit(1)).alias("taken"))
    values = taken.select("window_id", "grid_pos", (F.col("ret") / hold).alias("value"), F.explode(F.sequence(F.col("first"), F.col("first") + hold - 1)).alias("place"))
    points = params.select("grid_pos", F.col("max_holding_days").cast("int").alias("hold"))
    series = spans.crossJoin(F.broadcast(points)).join(counts, ["window_id", "grid_pos"], "left").withColumn("length", n - hold + F.coalesce("taken", F.lit(0)) * (hold - 1))  # windows x stated grid
    series = series.withColumn("over", F.col("length") > n).where("length > 0")
    every = series.select("window_id", "grid_pos", "s", "over", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("length"), n) - 1)).alias("place"))
    cost = (costs.buy_cost + costs.sell_cost) / 10
    ret = F.when(~F.col("over"), F.coalesce("value", F.lit(0.0)) - cost)
    return every.join(values, ["window_id", "grid_pos", "place"], "left").select("window_id", "grid_pos", (F.col("s") + F.col("place")).cast("int").alias("date_idx"), ret.alias("ret"))


def plain_sharpe(r: Column) -> Column:
    s = F.stddev_samp(r)
    return F.when(s > 1e-12, F.avg(r) / F.nullif(s, F.lit(0.0)) * F.sqrt(F.lit(float(TRADING_DAYS)))).otherwise(0.0)


def in_sample(panel: DataFrame, params: DataFrame, wins: DataFrame, strict: bool = False) -> DataFrame:
    """(window_id, grid_pos, sharpe) over the training spans; ``strict`` concatenates
    returns, and the Sharpe ratio of an undefined series is null."""
    spans = wins.select("window_id", F.col("train_start").alias("s"), F.col("train_end").alias("e"))
    found = (concatenated_returns if strict else returns)(panel, params, spans)
    defined = F.count("ret") == F.count(F.lit(1))
    return found.groupBy("window_id", "grid_pos").agg(F.when(defined, plain_sharpe(F.col("ret"))).alias("sharpe"))


def best(scores: DataFrame) -> DataFrame:
    """The first grid point with the highest score, per window."""
    place = F.row_number().over(Window.partitionBy("window_id").orderBy(F.round("sharpe", 9).desc_nulls_last(), "grid_pos"))
    return scores.withColumn("_k", place).where("_k = 1").drop("_k")


def out_of_sample(panel: DataFrame, params: DataFrame, wins: DataFrame, chosen: DataFrame, strict: bool = False) -> DataFrame:
    """(window_id, grid_pos, date_idx, ret) over the test spans, with the chosen points."""
    spans = wins.select("window_id", F.col("test_start").alias("s"), F.col("test_end").alias("e"))
    return (concatenated_returns if strict else returns)(panel, params, spans).join(chosen.select("window_id", "grid_pos"), ["window_id", "grid_pos"], "left_semi")


def summary(chosen: DataFrame, oos: DataFrame) -> DataFrame:
    """One row: results over all test dates, the ratio of in-sample to out-of-sample
    Sharpe and what it says."""
    r = F.col("ret")
    all_ = oos.agg(sharpe(r).alias("oos_sharpe"), sortino(r).alias("oos_sortino"), (F.product(1 + r) - 1).alias("oos_total_return"), (F.stddev_samp(r) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("oos_annual_vol"))
    per = oos.groupBy("window_id").agg(plain_sharpe(r).alias("oos"))
    means = chosen.join(per, "window_id").agg(F.avg("sharpe").alias("mean_is_sharpe"), F.avg("oos").alias("mean_oos_sharpe"), F.count(F.lit(1)).alias("windows"))
    ratio = F.when(F.abs(F.col("mean_oos_sharpe")) < 1e-12, F.lit(float("inf"))).otherwise(F.col("mean_is_sharpe") / F.nullif(F.col("mean_oos_sharpe"), F.lit(0.0)))
    out = all_.crossJoin(means).withColumn("overfitting_ratio", ratio)  # one row each
    return out.withColumn("status", F.when(F.col("overfitting_ratio") < 2, "ROBUST").when(F.col("overfitting_ratio") < 3, "MARGINAL").otherwise("OVERFITTING"))


def parameter_stability(chosen: DataFrame, params: DataFrame) -> DataFrame:
    """The chosen parameters of every window."""
    return chosen.join(params, "grid_pos").orderBy("window_id")


def with_callback(panel: DataFrame, params: DataFrame, wins: DataFrame, backtest: Callable[[pd.DataFrame, dict], tuple[float, pd.Series]]) -> DataFrame:
    """(window_id, grid_pos, sharpe) from a user's function of (training rows, parameters).
    Every (window, parameters) pair is a pandas group; a failure counts as no result."""
    days = calendar(panel).select("date", "date_idx")
    rows = panel.join(days, "date").join(F.broadcast(wins), (F.col("date_idx") >= F.col("train_start")) & (F.col("date_idx") < F.col("train_end")))
    names = [c for c in params.columns if c != "grid_pos"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            value = float(backtest(pdf.sort_values(["date", "ticker"]), {n: pdf[n].iloc[0] for n in names})[0])
        except Exception:  # noqa: BLE001
            value = None
        return pd.DataFrame([(pdf["window_id"].iloc[0], pdf["grid_pos"].iloc[0], value)], columns=["window_id", "grid_pos", "sharpe"])

    return rows.crossJoin(F.broadcast(params)).groupBy("window_id", "grid_pos").applyInPandas(one, "window_id int, grid_pos int, sharpe double")
