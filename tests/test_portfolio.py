"""The portfolio fold against an independent loop over a whole panel, every row compared."""

import dataclasses
import os

import numpy as np
import pytest

from tidemark.config import BacktestConfig, Config
from tidemark.operators import simulate
from tidemark.plans import queries, research

SMALL = "/root/testdata/sf0.001"
CFG = Config()


@pytest.fixture(scope="module")
def run(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    r = queries.calm(spark, SMALL)
    s, ranks = r.signals.cache(), r.rankings.cache()
    return s, ranks, r.regime, simulate.days_of(s, ranks, r.regime).cache()


def loop(signals, rankings, regime, rules, next_open):
    """The rules of a day, straight from rows: no arrays, no calendar of Spark's."""
    bar = {(x.date, x.ticker): x for x in signals.itertuples()}
    order = {}
    for x in rankings.sort_values(["date", "rank"]).itertuples():
        order.setdefault(x.date, []).append(x.ticker)
    label = dict(zip(regime["date"], regime["regime"]))
    dates = sorted(set(signals["date"]))
    cash, book, trades, curve = rules.initial_capital, [], [], []
    for d, after in zip(dates, [*dates[1:], None]):
        price = lambda h: bar[d, h["t"]].close if (d, h["t"]) in bar else h["paid"]  # noqa: B023, E731
        worth = sum(price(h) * h["n"] for h in book)
        curve.append((d, cash, worth, cash + worth, len(book)))
        why = {}
        for h in book:
            x = bar.get((d, h["t"]))
            if x is not None and not np.isnan(h["stop"]) and x.low <= h["stop"]:
                why[h["t"]] = "atr_stop"
            elif np.busday_count(h["since"], d) >= CFG.signals.max_hold_days:
                why[h["t"]] = "time_stop"
            elif x is not None and x.sell_signal:
                why[h["t"]] = x.exit_reason
        for h in sorted(book, key=lambda h: why.get(h["t"]) != "atr_stop"):
            if h["t"] not in why:
                continue
            at, on = price(h), d
            if next_open:
                x = bar.get((after, h["t"]))
                if x is None or (d, h["t"]) not in bar or not x.open > 0:
                    continue
                at, on = x.open, after
            got = at * (1 - rules.sell_cost - rules.slippage)
            cash += got * h["n"]
            trades.append((h["t"], h["since"], on, h["n"], h["paid"], got, why[h["t"]]))
            book = [b for b in book if b is not h]
        if after is None or label.get(d, "unknown") not in CFG.regime.allowed:
            continue
        held = {h["t"] for h in book}
        for t in order.get(d, []):
            if len(book) >= rules.max_positions or cash < rules.least_cash:
                break
            x = bar.get((after, t))
            if t in held or x is None or not x.open > 0:
                continue
            paid = x.open * (1 + rules.buy_cost + rules.slippage)
            cost = cash + sum(h["paid"] * h["n"] for h in book)
            n = int(min(cost / rules.max_positions, cost * rules.risk_per_trade, cash) // paid)
            if n > 0:
                cash -= n * paid
                book.append({"t": t, "since": after, "n": n, "paid": paid, "stop": paid - CFG.signals.atr_stop_multiplier * bar[d, t].atr})
    return trades, curve


@pytest.mark.parametrize("fill", ["close", "next_open"])
@pytest.mark.parametrize("tight", [False, True])
def test_fold_matches_a_loop(spark, run, fill, tight):
    """Every trade and equity row; ``tight`` lets cash and places run out."""
    s, ranks, market, days = run
    rules = BacktestConfig(exit_fill=fill, **({"initial_capital": 20_000.0, "max_positions": 2, "risk_per_trade": 0.6} if tight else {}))
    runs = simulate.simulated(days, simulate.scenarios(spark, rules), rules).cache()
    got_trades, got_curve = simulate.trades_of(runs).collect(), simulate.equity_of(runs).orderBy("date").collect()
    trades, curve = loop(s.toPandas(), ranks.toPandas(), market.toPandas(), rules, fill == "next_open")
    assert len(got_trades) == len(trades) > 20 and len(got_curve) == len(curve)
    for g, w in zip(got_trades, trades):
        assert (g.ticker, g.entry_date, g.exit_date, g.shares, g.exit_reason) == (*w[:4], w[6])
        assert np.allclose([g.entry_price, g.exit_price, g.pnl, g.pnl_pct], [w[4], w[5], (w[5] - w[4]) * w[3], w[5] / w[4] - 1])
        assert g.holding_days == (w[2] - w[1]).days
    for g, w in zip(got_curve, curve):
        assert g.date == w[0] and g.num_positions == w[4] and np.allclose([g.cash, g.invested_value, g.total_equity], w[1:4])
    if tight:
        assert max(x.num_positions for x in got_curve) == 2
    want = simulate.portfolio_summary(simulate.trades_of(runs), simulate.equity_of(runs)).first().asDict()
    have = simulate.summary_of(runs).first().asDict()
    assert have.keys() == want.keys() and all(have[k] == want[k] or abs(have[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_backtest_plans_on_settled_inputs(spark, run):
    """The run's plan, which the metrics repeat, holds a few scans and not the panel's plan many times."""
    s, ranks, market, days = run
    b = research.backtest(research.Research(s, market, s, ranks))
    try:
        assert b.runs._jdf.queryExecution().analyzed().collectLeaves().size() < 10
        assert b.equity.collect() == simulate.simulated_equity(days, simulate.scenarios(spark)).collect()
        assert b.metrics.first().total_trades == b.trades.count() > 20
    finally:
        b.release()


def test_unknown_fill_is_refused(spark, run):
    with pytest.raises(ValueError):
        simulate.simulated(run[3], simulate.scenarios(spark), dataclasses.replace(CFG.backtest, exit_fill="midday"))
