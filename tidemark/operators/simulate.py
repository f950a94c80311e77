"""Portfolio simulation: the one operator whose state (cash, positions) couples all tickers.

The panel is reduced in Spark to one row per (scenario, date) with arrays of the bars and
candidates, so that the fold reads days, not bars. Scenarios are independent groups and
run in parallel; inside a scenario the fold is sequential by nature."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig, RegimeConfig, SignalConfig
from ..functions import by_ticker, holds
from ..schemas import EQUITY, TRADES
from .ranking import calendar


@dataclass
class Position:
    ticker: str
    entry_date: object
    entry_price: float
    shares: int
    stop_loss: float


@dataclass
class Portfolio:
    """Cash and open positions, in order of opening; trades and equity so far."""

    capital: float
    buy_cost: float
    sell_cost: float
    rules: BacktestConfig
    signals: SignalConfig
    cash: float = 0.0
    held: dict[str, Position] = field(default_factory=dict)
    trades: list[tuple] = field(default_factory=list)
    equity: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.cash, self.held, self.trades, self.equity = self.capital, {}, [], []

    def at_cost(self) -> float:
        return self.cash + sum(p.entry_price * p.shares for p in self.held.values())

    def has_room(self) -> bool:
        return len(self.held) < self.rules.max_positions and self.cash >= self.rules.least_cash

    def mark(self, date, prices: dict[str, float]) -> None:  # noqa: ANN001
        invested = sum(prices.get(t, p.entry_price) * p.shares for t, p in self.held.items())
        total = self.cash + invested
        self.equity.append((date, self.cash, invested, total, len(self.held), invested / total if total > 0 else 0.0))

    def open(self, ticker: str, date, price: float, atr: float | None) -> None:  # noqa: ANN001
        paid = price * (1 + self.buy_cost + self.rules.slippage)
        worth = self.at_cost()
        shares = int(min(worth / self.rules.max_positions, worth * self.rules.risk_per_trade, self.cash) // paid)
        if shares > 0:
            self.cash -= shares * paid
            self.held[ticker] = Position(ticker, date, paid, shares, paid - self.signals.atr_stop_multiplier * atr if atr is not None else np.nan)

    def close(self, ticker: str, date, price: float, reason: str) -> None:  # noqa: ANN001
        p = self.held.pop(ticker)
        got = price * (1 - self.sell_cost - self.rules.slippage)
        self.cash += got * p.shares
        self.trades.append((ticker, p.entry_date, date, p.entry_price, got, p.shares, (got - p.entry_price) * p.shares, got / p.entry_price - 1, (date - p.entry_date).days, reason))

    def day(self, date, next_date, allowed: bool, bars: dict[str, tuple], candidates: list[tuple]) -> None:  # noqa: ANN001
        """bars: ticker -> (close, low, sell signal, reason, open of the next date or None);
        candidates in rank order: (ticker, atr or None, whether there is a bar today, open of
        the next date or None).

        With ``exit_fill`` "next_open" an exit decided today is filled at the ticker's open of
        the next date, as entries are, and frees its cash and place today; without such an
        open the position stays and is judged again on the next date."""
        close = {t: bars[t][0] if t in bars else p.entry_price for t, p in self.held.items()}
        self.mark(date, close)

        def leave(ticker: str, reason: str) -> None:
            if self.rules.exit_fill == "close":
                self.close(ticker, date, close[ticker], reason)
            elif next_date is not None and ticker in bars and bars[ticker][4] is not None and bars[ticker][4] > 0:
                self.close(ticker, next_date, bars[ticker][4], reason)
            else:
                stuck.add(ticker)

        stuck: set[str] = set()
        for t in [t for t, p in self.held.items() if t in bars and bars[t][1] <= p.stop_loss]:
            leave(t, "atr_stop")
        for t, p in [x for x in self.held.items() if x[0] not in stuck]:
            days = int(np.busday_count(p.entry_date, date)) if date > p.entry_date else 0
            if days >= self.signals.max_hold_days:
                leave(t, "time_stop")
            elif t in bars and bars[t][2]:
                leave(t, bars[t][3] or "mean_reversion")
        if not allowed or next_date is None:
            return
        before = set(self.held)
        for ticker, atr, has_bar, price in candidates:
            if not self.has_room():
                break
            if ticker in before or price is None or not price > 0:
                continue
            self.open(ticker, next_date, price, atr if has_bar else price * self.rules.fallback_atr)


#: The columns of the signals that the simulation reads.
SEEN = ("ticker", "date", "open", "low", "close", "atr", "sell_signal", "exit_reason")


def days_of(signals: DataFrame, rankings: DataFrame, regime: DataFrame, rules: RegimeConfig = RegimeConfig()) -> DataFrame:
    """One row per date: next date, whether entries are allowed, bars, candidates.

    A candidate's next bar is the ticker's next row, if that is on the next date of the
    common calendar. Only tickers that are ever ranked matter to the fold; the others' bars
    are left out. One join brings the ranks, one window by ticker the rest, and one
    aggregate makes both arrays."""
    days = calendar(signals)
    df = signals.select("ticker", "date", "open", "low", "close", "atr", holds(F.col("sell_signal")).alias("sell"), "exit_reason")
    df = df.join(rankings.select("date", "ticker", "rank"), ["date", "ticker"], "left")
    w = by_ticker()
    df = df.withColumns({"bar_after": F.lead("date", 1).over(w), "open_after": F.lead("open", 1).over(w), "traded": F.count("rank").over(Window.partitionBy("ticker")) > 0})
    df = df.where("traded").join(days.select("date", "next_date"), "date")
    after = F.when(F.col("bar_after") == F.col("next_date"), F.col("open_after"))
    arrays = df.groupBy("date").agg(
        F.collect_list(F.struct("ticker", "close", "low", "sell", "exit_reason", after.alias("open_after"))).alias("bars"),
        F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "ticker", "atr", F.lit(True).alias("has_bar"), after.alias("open"))))).alias("picks"),
    )
    ok = regime.select("date", holds(F.col("regime").isin(*rules.allowed)).alias("allowed"))
    return days.join(ok, "date", "left").join(arrays, "date", "left").withColumn("allowed", holds(F.col("allowed")))


def _fold(pdf: pd.DataFrame, rules: BacktestConfig, signals: SignalConfig) -> Portfolio:
    pdf = pdf.sort_values("date_idx")
    p = Portfolio(float(pdf["capital"].iloc[0]), float(pdf["buy_cost"].iloc[0]), float(pdf["sell_cost"].iloc[0]), rules, signals)
    for date, nxt, allowed, bars, picks in zip(pdf["date"], pdf["next_date"], pdf["allowed"], pdf["bars"], pdf["picks"], strict=True):
        b = {x["ticker"]: (x["close"], x["low"], x["sell"], x["exit_reason"], x["open_after"]) for x in (bars if bars is not None else [])}
        c = [(x["ticker"], x["atr"], bool(x["has_bar"]), x["open"]) for x in (picks if picks is not None else [])]
        p.day(date, None if pd.isna(nxt) else nxt, bool(allowed), b, c)
    return p


def scenarios(spark, rules: BacktestConfig = BacktestConfig(), costs: tuple[float, ...] | None = None) -> DataFrame:  # noqa: ANN001
    """(scenario_id, capital, buy_cost, sell_cost): the given settings, or one scenario
    per round-trip cost, split half and half."""
    rows = [("base", rules.initial_capital, rules.buy_cost, rules.sell_cost)] if costs is None else [(f"cost_{c:g}", rules.initial_capital, c / 2, c / 2) for c in costs]
    return spark.createDataFrame(rows, "scenario_id string, capital double, buy_cost double, sell_cost double")


def _grouped(days: DataFrame, which: DataFrame):  # noqa: ANN202
    return days.crossJoin(F.broadcast(which)).groupBy("scenario_id")  # a handful of stated scenarios


#: The two tables of a run as arrays of one row.
_RUN = f"scenario_id string, trades array<struct<{TRADES.split(', ', 1)[1]}>>, equity array<struct<{EQUITY.split(', ', 1)[1]}>>"


def simulated(days: DataFrame, which: DataFrame, rules: BacktestConfig = BacktestConfig(), signals: SignalConfig = SignalConfig()) -> DataFrame:
    """One row per scenario with the arrays ``trades`` and ``equity`` of one fold: a row of
    ``equity`` a date, at most ``max_positions`` new trades a date. Persist it to read both."""
    if rules.exit_fill not in ("close", "next_open"):
        raise ValueError(f"exit_fill is close or next_open, not {rules.exit_fill}")
    names = {k: [c.split()[0] for c in kind.split(", ")[1:]] for k, kind in (("trades", TRADES), ("equity", EQUITY))}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _fold(pdf, rules, signals)
        rows = {k: [dict(zip(names[k], row, strict=True)) for row in table] for k, table in (("trades", p.trades), ("equity", p.equity))}
        return pd.DataFrame({"scenario_id": [pdf["scenario_id"].iloc[0]], "trades": [rows["trades"]], "equity": [rows["equity"]]})

    return _grouped(days, which).applyInPandas(one, _RUN)


def trades_of(runs: DataFrame) -> DataFrame:
    return runs.select("scenario_id", F.inline("trades"))


def equity_of(runs: DataFrame) -> DataFrame:
    return runs.select("scenario_id", F.inline("equity"))


def simulated_trades(days: DataFrame, which: DataFrame, rules: BacktestConfig = BacktestConfig(), signals: SignalConfig = SignalConfig()) -> DataFrame:
    return trades_of(simulated(days, which, rules, signals))


def simulated_equity(days: DataFrame, which: DataFrame, rules: BacktestConfig = BacktestConfig(), signals: SignalConfig = SignalConfig()) -> DataFrame:
    return equity_of(simulated(days, which, rules, signals))


def benchmark_equity(index: DataFrame, capital: float = BacktestConfig().initial_capital) -> DataFrame:
    """Buying and holding the index from its first date."""
    first = F.first("close").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return index.select("date", (F.lit(capital) * F.col("close") / first).alias("equity"))


def portfolio_summary(trades: DataFrame, equity: DataFrame) -> DataFrame:
    """One row per scenario: last cash, equity and open positions, trade counts and results."""
    last = equity.groupBy("scenario_id").agg(F.max_by(F.struct("cash", "total_equity", "num_positions"), "date").alias("x")).select("scenario_id", "x.*")
    n = F.count(F.lit(1))
    won = F.sum((F.col("pnl") > 0).cast("long"))
    done = trades.groupBy("scenario_id").agg(n.alias("total_trades"), won.alias("winning_trades"), (n - won).alias("losing_trades"), (won / n).alias("win_rate"), F.sum("pnl").alias("total_pnl"), F.avg("pnl_pct").alias("avg_pnl_pct"))
    return last.join(done, "scenario_id", "left").fillna(0)


def summary_of(runs: DataFrame) -> DataFrame:
    """``portfolio_summary`` of ``simulated`` rows, from their arrays: one pass, one fold."""
    last, pnl = F.try_element_at("equity", F.lit(-1)), F.col("trades.pnl")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    n, won = F.size("trades"), F.size(F.filter(pnl, lambda x: x > 0))
    share = lambda x: x / F.nullif(n, F.lit(0))
    out = runs.select(
        "scenario_id", last["cash"].alias("cash"), last["total_equity"].alias("total_equity"), last["num_positions"].alias("num_positions"), n.cast("long").alias("total_trades"),
        won.cast("long").alias("winning_trades"), (n - won).cast("long").alias("losing_trades"), share(won).alias("win_rate"), total(pnl).alias("total_pnl"), share(total(F.col("trades.pnl_pct"))).alias("avg_pnl_pct"),
    )
    return out.fillna(0)
