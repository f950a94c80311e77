"""Bar operators against independent pandas versions, edge cases and invariants."""

import datetime as dt
import random
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import BacktestConfig, Config, DataConfig, RankingConfig
from tidemark.functions import business_days, percent_rank_average
from tidemark.functions.ewm import ewm, ewm_gapped
from tidemark.operators import clean, features, indicators, metrics, ranking, regime, signals, simulate, trades, walk_forward

DAY = dt.date(2024, 1, 1)


def panel(n=300, tickers=("A", "B", "C"), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o, h, low = c[i] * (1 + rng.normal(0, 0.003)), c[i] * 1.01, c[i] * 0.985
            out.append((t, DAY + dt.timedelta(days=i), o, h, low, float(c[i]), float(rng.integers(100, 1000))))
    return pd.DataFrame(out, columns=["ticker", "date", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(panel()).cache()


def by(df, column):
    return {(r["ticker"], r["date"]): r[column] for r in df.collect()}


def close(a, b, tol=1e-9):
    return (a is None or (isinstance(a, float) and np.isnan(a))) and (b is None or np.isnan(b)) or abs(a - b) <= tol * max(1, abs(b))


def test_ewm_matches_pandas(spark, bars):
    alphas = {"a": 0.5, "b": 1 / 14, "c": 2 / 51, "d": 2 / 10, "e": 1.0, "f": 0.9, "g": 2 / 201}
    got = ewm(bars, {k: ("close", a, 3) for k, a in alphas.items()}).toPandas().sort_values(["ticker", "date"])
    for k, a in alphas.items():
        want = got.groupby("ticker")["close"].transform(lambda s: s.ewm(alpha=a, adjust=False, min_periods=3).mean())
        assert np.allclose(got[k], want, rtol=1e-12, equal_nan=True)


def test_ewm_gapped(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, None, 3.0])], "ticker string, date int, x double")
    assert [round(r.y, 6) for r in ewm_gapped(df, "x", 0.5, 1, "y").orderBy("date").collect()] == [1.0, 1.0, 2.333333]


def test_indicators_match_pandas(bars):
    df = indicators.with_all(bars).toPandas().sort_values(["ticker", "date"])
    for _, g in df.groupby("ticker"):
        c = g["close"]
        assert np.allclose(g["sma_20"], c.rolling(20).mean(), equal_nan=True)
        assert np.allclose(g["bb_upper"], c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), equal_nan=True)
        assert np.allclose(g["zscore"], (c - c.shift(1).rolling(20).mean()) / c.shift(1).rolling(20).std(), equal_nan=True)
        assert np.allclose(g["volatility_ann"], np.log(c / c.shift(1)).rolling(20).std() * 252**0.5, equal_nan=True)
        d = c.diff()
        up, down = d.clip(lower=0).ewm(alpha=0.5, adjust=False, min_periods=2).mean(), (-d).clip(lower=0).ewm(alpha=0.5, adjust=False, min_periods=2).mean()
        rsi = (100 - 100 / (1 + up / down.replace(0, np.nan))).fillna(100)
        rsi[:2] = np.nan
        assert np.allclose(g["rsi_2"], rsi, equal_nan=True)
        assert g["rsi_2"].dropna().between(0, 100).all()


def test_flat_prices(spark):
    flat = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(30)], "ticker string, date date, open double, high double, low double, close double, volume double")
    last = indicators.with_all(flat).orderBy(F.desc("date")).first()
    assert last["rsi_2"] == 100 and last["zscore"] is None and last["bb_pct_b"] is None and last["sma_200"] is None


def test_no_look_ahead(spark, bars):
    cut = DAY + dt.timedelta(days=200)
    index = bars.groupBy("date").agg(F.avg("close").alias("close"))
    make = lambda b, i: features.with_all(indicators.with_all(b), i)
    full, part = make(bars, index), make(bars.where(F.col("date") <= F.lit(cut)), index.where(F.col("date") <= F.lit(cut)))
    for c in ("zscore", "rsi", "mean_reversion_score", "cs_percentile_rsi"):
        a, b = by(full.where(F.col("date") <= F.lit(cut)), c), by(part, c)
        assert all(close(a[k], b[k], 1e-6) for k in b)


def test_cleaning(spark):
    d = lambda i: DAY + dt.timedelta(days=i)
    rows = [("A", d(i), 1.0, 1.0, 1.0, None if 1 <= i <= 6 else 1.0, 1.0) for i in range(40)]
    rows += [("B", d(0), 1.0, 1.0, 2.0, 1.0, 1.0), ("B", d(1), 0.0, 1.0, 1.0, 1.0, 1.0), ("B", d(2), 1.0, 1.0, 1.0, 1.0, -1.0), ("B", d(3), 1.0, 1.0, 1.0, float("nan"), 1.0)]
    rows += [("C", d(i), 1.0, 1.0, 1.0, 1.0, -1.0 if i == 0 else 1.0) for i in range(5)]
    raw = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    stats = {r.ticker: r for r in clean.cleaning_stats(raw).collect()}
    assert stats["A"].gaps_filled == 5 and stats["A"].final_rows == 39 and stats["A"].accepted
    assert not stats["B"].accepted and stats["C"].accepted  # exactly a fifth is accepted
    assert {r.ticker for r in clean.clean(raw).select("ticker").distinct().collect()} == {"A", "C"}
    assert clean.cleaning_report(clean.cleaning_stats(raw)).first().asDict() == {"tickers_processed": 3, "tickers_kept": 2, "tickers_dropped": 1}
    with pytest.raises(ValueError):
        clean.require_columns(raw.drop("volume"))
    assert clean.standardise_columns(raw.toDF("Ticker", " Date", "Open", "HIGH", "low", "Adj Close", "volume")).columns == ["ticker", "date", "open", "high", "low", "adj_close", "volume"]
    assert clean.deduplicated(raw.union(raw)).count() == raw.count()
    assert clean.clean(raw.limit(0)).count() == 0


def test_ranks_and_scores(spark):
    df = spark.createDataFrame([(DAY, "A", 1.0), (DAY, "B", 1.0), (DAY, "C", 3.0), (DAY, "D", None)], "date date, ticker string, x double")
    got = {r.ticker: r.p for r in df.withColumn("p", percent_rank_average(df, "x")).collect()}
    assert got == {"A": 50.0, "B": 50.0, "C": 100.0, "D": None}
    one = features.with_component_scores(spark.createDataFrame([(DAY, "A", 1.0)], "date date, ticker string, rsi double")).first()
    assert one["rsi_score"] == 0.5 and one["zscore_score"] is None
    with pytest.raises(ValueError):
        RankingConfig(rsi=0.5).validate()


def test_business_days(spark):
    rng = np.random.default_rng(0)
    pairs = [(DAY + dt.timedelta(days=int(a)), DAY + dt.timedelta(days=int(a + b))) for a, b in rng.integers(0, 400, (100, 2))]
    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", business_days(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == np.busday_count(r.a, r.b) for r in df.collect())


def confirm(raw, days):
    """The rule, as a loop."""
    out, current, last, run = [], None, None, 0
    for i, x in enumerate(raw):
        if i == 0 and x is not None:
            current, last, run = x, x, 2
        elif x is not None:
            run = run + 1 if x == last else 1
            last = x
            if run >= days:
                current = x
        out.append(current)
    return out


@pytest.mark.parametrize("warm", [0, 4])
def test_confirmation(spark, warm):
    rng = np.random.default_rng(warm)
    raw = [None] * warm + [str(x) for x in np.repeat(rng.choice(["a", "b", "c"], 40), rng.integers(1, 5, 40))]
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), x) for i, x in enumerate(raw)], "date date, raw_regime string")
    assert [r.regime for r in regime.confirmed(df, 3).orderBy("date").collect()] == confirm(raw, 3)


def test_signals_thresholds(spark):
    cols = "ticker string, date date, close double, rsi double, zscore double, bb_lower double, relative_weakness double, volume_spike double, atr double"
    df = spark.createDataFrame([("A", DAY, 1.0, 5.0, -2.0, 2.0, 0.0, 1.0, 1.0), ("B", DAY, 1.0, None, None, None, None, None, None), ("C", DAY, 1.0, 80.0, 1.0, 0.5, 0.0, 1.0, 1.0)], cols)
    market = spark.createDataFrame([(DAY, "bearish")], "date date, regime string")
    got = {r.ticker: r for r in signals.with_all(df, market).collect()}
    assert got["A"].buy_signal and got["A"].buy_conditions_met == "rsi_oversold,zscore_low,below_bb_lower" and got["A"].conditions_count == 3
    assert not got["B"].buy_signal and got["B"].signal_strength == 0 and not got["B"].sell_signal
    assert got["C"].sell_signal and got["C"].exit_reason == "mean_reversion"


@pytest.fixture(scope="module")
def study(spark, bars):
    feats = features.with_all(indicators.with_all(bars), bars.groupBy("date").agg(F.avg("close").alias("close")))
    market = bars.select("date").distinct().withColumn("regime", F.lit("mild_bull"))
    s = signals.with_all(feats, market).cache()
    return s, ranking.ranked(s).cache(), market


def test_simulation_invariants(spark, study):
    s, ranks, market = study
    days, which = simulate.days_of(s, ranks, market), simulate.scenarios(spark)
    equity, done = simulate.simulated_equity(days, which).toPandas(), simulate.simulated_trades(days, which).toPandas()
    assert len(done) and (equity["num_positions"] <= 5).all()
    assert np.allclose(equity["cash"] + equity["invested_value"], equity["total_equity"])
    assert set(done["exit_reason"]) <= {"atr_stop", "time_stop", "mean_reversion", "rsi_exit"}
    assert (done["entry_date"] <= done["exit_date"]).all()
    per = ranks.groupBy("date").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("u")).collect()
    assert all(r.m == r.n == r.u for r in per)
    summary = simulate.portfolio_summary(simulate.simulated_trades(days, which), simulate.simulated_equity(days, which)).first()
    assert summary.total_trades == len(done)
    m = metrics.compute_all(simulate.simulated_equity(days, which), simulate.simulated_trades(days, which)).first()
    assert m.total_trades == len(done) and m.max_drawdown <= 0 and 0 <= m.exposure <= 1


def test_fold_by_hand():
    rules = BacktestConfig(buy_cost=0.0, sell_cost=0.0, slippage=0.0)
    p = simulate.Portfolio(10_000.0, 0.0, 0.0, rules, Config().signals)
    d = [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    p.day(d[0], d[1], True, {}, [("A", 1.0, True, 10.0), ("B", 1.0, True, None), ("C", None, False, 10.0)])
    assert [x.shares for x in p.held.values()] == [20, 20] and p.held["A"].stop_loss == 8.0 and abs(p.held["C"].stop_loss - 9.6) < 1e-9
    p.day(d[1], d[2], False, {"A": (7.0, 7.5, False, "")}, [])
    assert p.trades[0][0] == "A" and p.trades[0][-1] == "atr_stop" and p.trades[0][4] == 7.0
    assert p.equity[1][3] == 10_000 - 20 * 3  # C has no bar: at its entry price


def test_metrics_edges(spark):
    e = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate([100, 120, 90, 120])], "date date, equity double")
    m = metrics.max_drawdown(e).first()
    assert m.max_drawdown == -0.25 and m.peak_date == DAY + dt.timedelta(days=1) and m.recovery_date is None  # regained on one day only
    t = spark.createDataFrame([(1.0,), (2.0,)], "pnl double")
    assert t.agg(metrics.profit_factor()).first()[0] == float("inf")
    r = metrics.daily_returns(e)
    x = r.toPandas()["ret"]
    s = metrics.return_stats(r).first()
    assert close(s.skewness, x.skew()) and s.kurtosis is None


def test_max_drawdown_reads_its_curve_once(spark):
    """Values that differ between two computations, as sums of doubles do in their last bits."""
    drift = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()  # forked workers share the seed of random.random
    e = spark.range(40, numPartitions=2).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("date"), (100 - F.col("id") + drift() * 1e-9).alias("equity"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        m = metrics.max_drawdown(e).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert m.peak_date == dt.date(2024, 1, 1) and m.trough_date == dt.date(2024, 2, 9) and close(m.max_drawdown, -0.39)


def test_max_drawdown_skips_a_peak_of_zero(spark):
    z = spark.createDataFrame([(DAY + dt.timedelta(days=i), v) for i, v in enumerate([None, 0.0, 100.0, 50.0, 40.0])], "date date, equity double")
    m = metrics.max_drawdown(z).first()
    assert m.max_drawdown == -0.6 and m.peak_date == DAY + dt.timedelta(days=2) and m.trough_date == DAY + dt.timedelta(days=4)


def test_walk_forward(spark, bars):
    df = indicators.with_rsi(bars.withColumn("zscore", indicators.zscore(F.col("close"))), 2).withColumnRenamed("rsi_2", "rsi")
    cfg = walk_forward.WalkForwardConfig(in_sample=100, out_of_sample=30, step=50, grid={"rsi_buy_threshold": (20, 50), "zscore_buy_threshold": (-1.0, 0.0), "max_holding_days": (3,)})
    grid, wins = walk_forward.grid(spark, cfg.grid), walk_forward.windows(ranking.calendar(df), cfg)
    assert wins.count() == 4
    best = walk_forward.best(walk_forward.in_sample(df, grid, wins))
    oos = walk_forward.out_of_sample(df, grid, wins, best)
    assert best.count() == 4 and oos.count() == 4 * 30
    assert walk_forward.summary(best, oos).first().status in {"ROBUST", "MARGINAL", "OVERFITTING"}
    assert walk_forward.windows(ranking.calendar(df.limit(3)), cfg).count() == 0
    user = walk_forward.with_callback(df, grid, wins, lambda pdf, p: (p["rsi_buy_threshold"], None))
    assert {r.grid_pos for r in walk_forward.best(user).collect()} == {2}


def test_walk_forward_queries_match_a_loop(spark, monkeypatch):
    """The registered queries over all windows and points of the defaults."""
    from tidemark.plans import queries

    pdf, cfg = panel(400), Config().walk_forward
    df = spark.createDataFrame(pdf).cache()
    monkeypatch.setattr(queries, "bars", lambda spark, d: df)
    run = lambda name: queries.QUERIES[name](spark, "").collect()
    assert sorted(r.train_start for r in run("wfo_windows")) == [0, 63]
    z = indicators.with_rsi(df.withColumn("zscore", indicators.zscore(F.col("close"))), 2).toPandas()
    z["i"] = (pd.to_datetime(z["date"]) - pd.Timestamp(DAY)).dt.days
    price, points = z.set_index(["ticker", "i"])["close"].to_dict(), list(product(*cfg.grid.values()))

    def rets(point, s, e):
        rsi, zs, hold, _ = point
        got = {i: [] for i in range(s, e)}
        hit = z[(z["rsi_2"] < rsi) & (z["zscore"] < zs) & (z["i"] >= s) & (z["i"] + hold < e)].sort_values("ticker")
        for i, g in hit.groupby("i"):
            r = np.mean([price[t, i + hold] / price[t, i] - 1 for t in g["ticker"][:5]])
            for j in range(i, i + hold):
                got[j].append(r / hold)
        return [(np.mean(x) if x else 0) - 0.0003 for x in got.values()]

    def score(point, s, e):
        x = rets(point, s, e)
        return np.mean(x) / np.std(x, ddof=1) * 252**0.5 if np.std(x, ddof=1) > 1e-12 else 0.0

    want = {(w, g): score(p, 63 * w, 63 * w + 252) for w in (0, 1) for g, p in enumerate(points)}
    got = {(r.window_id, r.grid_pos): r.sharpe for r in run("wfo_insample")}
    assert len(got) == 2 * 192 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    top = {w: min(range(192), key=lambda g: (-round(want[w, g], 9), g)) for w in (0, 1)}
    assert {r.window_id: r.grid_pos for r in run("wfo_best")} == top
    oos = {(w, 63 * w + 252 + k): r for w in (0, 1) for k, r in enumerate(rets(points[top[w]], 63 * w + 252, 63 * w + 315))}
    got = {(r.window_id, r.date_idx): r.ret for r in run("wfo_oos")}
    assert got.keys() == oos.keys() and all(abs(got[k] - oos[k]) < 1e-5 for k in oos)
    assert run("wfo_summary")[0].windows == 2


def test_pivot_query_holds_all_tickers(spark, monkeypatch):
    from tidemark.plans import queries

    pdf = panel(3, ("Brand#11", "Brand#2", "Brand#55"))
    monkeypatch.setattr(queries, "bars", lambda spark, d: spark.createDataFrame(pdf))
    got = queries.QUERIES["pivot_close"](spark, "")
    assert set(got.columns) == {"date", *pdf["ticker"]} and got.count() == 3
    cells = {(t, r["date"]): r[t] for r in got.collect() for t in got.columns[1:]}
    assert all(abs(cells[r.ticker, r.date] - r.close) < 1e-3 for r in pdf.itertuples())


def test_uncoupled_trades_match_a_loop(study):
    s, _, _ = study
    pdf = s.toPandas().sort_values("date")
    dates = sorted(pdf["date"].unique())
    row = {(r.ticker, r.date): r for r in pdf.itertuples()}
    got = {(r.ticker, r.signal_date): r for r in trades.uncoupled_trades(s).collect()}
    n = 0
    for r in pdf[pdf["buy_signal"]].itertuples():
        i = dates.index(r.date)
        if i + 1 == len(dates):
            continue
        entry = row[r.ticker, dates[i + 1]]
        price = entry.open * 1.002
        stop, want = price - 2 * r.atr, None
        for d in dates[i + 1 :]:
            x = row[r.ticker, d]
            why = "atr_stop" if x.low <= stop else "time_stop" if np.busday_count(entry.date, d) >= 10 else x.exit_reason if x.sell_signal else None
            if why:
                want = (d, why)
                break
        g = got[r.ticker, r.date]
        assert (g.exit_date, g.exit_reason) == (want or (None, None))
        n += 1
    assert n == len(got) > 0


def test_sources_and_sinks(spark, bars, tmp_path):
    from tidemark.sources import fetch, files, universe

    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "M_M.NS.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nnot a date,1,1,1,1,1\n2024-01-03,,2,0.5,1.5,10\n")
    got = files.read_csv_bars(spark, str(folder)).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.open) for r in got] == [("M_M.NS", "2024-01-02", 1.0), ("M_M.NS", "2024-01-03", None)]
    assert files.safe_filename("M&M.NS") == "M_M.NS"
    files.write_bars(bars, str(tmp_path / "bars"))
    assert files.read_bars(spark, str(tmp_path / "bars")).count() == bars.count()
    assert files.recent(bars, 10).count() < bars.count()
    calls = []

    def failing(symbol, start, end):
        calls.append(symbol)
        raise OSError

    assert fetch.fetched(failing, "X", DataConfig(), sleep=lambda s: None) == [] and len(calls) == 3
    assert fetch.chunks([1, 2, 3], 2) == [[1, 2], [3]]
    naps = []
    one = lambda symbol, start, end: [(symbol,)]
    assert list(fetch.fetched_chunks(one, [[("a", "A"), ("b", "B")], [("c", "C")]], DataConfig(), naps.append)) == [("a", "A"), ("b", "B"), ("c", "C")] and naps == [2.0]
    rows = lambda symbol, start, end: [(dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert fetch.load(spark, rows, {"a": "A", "b": "B"}, name="fake_bars").count() == 2
    quick = DataConfig(chunk_size=1, chunk_delay=0.0, index_delay=0.0)
    assert fetch.load(spark, rows, dict.fromkeys("abcde", "X"), quick, name="fake_lanes", lanes=2).count() == 5
    assert {r.index_name for r in fetch.load_indexes(spark, rows, quick).collect()} == set(universe.INDEXES)
    assert universe.universe(spark, ["B", "A", "A"], ".NS").count() == 2 and universe.universe(spark).count() == 50
    listing = "<table><tr><th>Rank</th></tr></table><table><tr><th>Name</th><th> Symbol</th></tr>" + "".join(f"<tr><td>n{i}</td><td><a>S{i}</a>&amp;</td></tr>" for i in range(45)) + "</table>"
    (tmp_path / "list.html").write_text(listing)
    assert "S7&.NS" in {r.symbol for r in universe.read_universe(spark, str(tmp_path / "list.html"), ".NS").collect()}
    with pytest.raises(RuntimeError):
        universe.listed_symbols(listing.replace("Symbol", "Code"))
    u = ranking.universe_difference(universe.universe(spark, ["A", "B"]), universe.universe(spark, ["B", "C"]))
    assert {(r.symbol, r.status) for r in u.collect()} == {("C", "added"), ("A", "removed"), ("B", "common")}


def test_report(spark, study, tmp_path):
    from tidemark.plans.research import Backtest
    from tidemark.report import charts, html
    from tidemark.sources import files

    s, ranks, market = study
    days, which = simulate.days_of(s, ranks, market), simulate.scenarios(spark)
    equity, done = simulate.simulated_equity(days, which).cache(), simulate.simulated_trades(days, which).cache()
    page = html.write_report(Backtest(equity, done, metrics.compute_all(equity, done)), str(tmp_path))
    text = page.read_text()
    assert "<svg" in text and "Sharpe Ratio" in text
    assert "Cagr" in html.metrics_text({"cagr": 0.1}) and "10.00%" in html.metrics_text({"cagr": 0.1})
    files.export_trade_log(done, str(tmp_path / "trades"))
    files.export_equity_curve(equity, str(tmp_path / "equity"))
    files.export_watchlist(ranks, str(tmp_path / "watch"))
    assert spark.read.option("header", True).csv(str(tmp_path / "equity")).columns[1] == "date"
    assert charts.signal_chart(s, "A").count() > 0 and charts.ranked_table(ranks).count() <= 10
    assert charts.regime_chart(market.withColumn("close", F.lit(1.0)))[1].count() == 1
    r = metrics.daily_returns(equity.select("date", F.col("total_equity").alias("equity")))
    assert charts.monthly_heatmap(r).count() == 1 and charts.rolling_sharpe_chart(r).count() == r.count() and charts.distribution_chart(r)[1].count() == 1
    assert charts.drawdown_chart(equity).where("is_trough").count() == 1


def test_stream_matches_batch(spark, tmp_path):
    from tidemark.streaming import bars as tick_bars

    rows = [("A", dt.datetime(2024, 1, 1, h, m), i, float(h * 10 + m % 7), 1.0) for i, (h, m) in enumerate((h, m) for h in range(5) for m in range(0, 60, 7))]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, seq int, price double, volume double")
    df.write.parquet(str(tmp_path / "ticks"))
    stream = tick_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ticks")))
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, tick_bars(df).collect()))


def test_last_row_of_a_file_stays(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n" + "".join(f"2024-01-02,{9 - i},9,1,{9 - i},10\n" for i in range(5)))
    kept = clean.deduplicated(files.read_csv_bars(spark, str(tmp_path)), "source_row").collect()
    assert [r.close for r in kept] == [5.0]


def test_score_takes_components_with_any_value(spark):
    """A component without any value shares its weight out; one with some nulls does not."""
    none = dict.fromkeys(("zscore_score", "relative_weakness_score", "volume_exhaustion_score", "atr_norm_score", "dist_from_ma_score"))
    rows = [(1, 0.5, 1.0), (2, 0.5, None)]
    df = spark.createDataFrame(rows, "k int, rsi_score double, zscore_score double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in none if c != "zscore_score"})
    got = {r.k: r.mean_reversion_score for r in features.with_mean_reversion_score(df).collect()}
    assert close(got[1], (0.5 * 0.20 + 1.0 * 0.25) / 0.45) and got[2] is None
    named = {r.k: r.mean_reversion_score for r in features.with_mean_reversion_score(df, available={"rsi_score"}).collect()}
    assert close(named[1], 0.5) and close(named[2], 0.5)
    empty = features.with_mean_reversion_score(df.withColumns({c: F.lit(None).cast("double") for c in ("rsi_score", "zscore_score")}))
    assert [r.mean_reversion_score for r in empty.collect()] == [None, None]


def test_strict_walk_forward_matches_a_loop(spark):
    """Values concatenated in order of their dates, null where there are too many."""
    pdf = panel(90, seed=5)
    rng = np.random.default_rng(3)
    pdf["rsi"], pdf["zscore"] = rng.uniform(0, 100, len(pdf)), rng.normal(0, 1, len(pdf))
    df = spark.createDataFrame(pdf).cache()
    cfg = walk_forward.WalkForwardConfig(in_sample=40, out_of_sample=20, step=20, grid={"rsi_buy_threshold": (0.5, 2, 60), "zscore_buy_threshold": (1.0,), "max_holding_days": (2, 5)})
    grid, wins = walk_forward.grid(spark, cfg.grid), walk_forward.windows(ranking.calendar(df), cfg)
    pdf["i"] = [(d - DAY).days for d in pdf["date"]]
    price = pdf.set_index(["ticker", "i"])["close"].to_dict()

    def series(point, s, e):
        rsi, z, hold = point
        out = []
        for i in range(s, e - int(hold)):
            names = sorted(pdf[(pdf["i"] == i) & (pdf["rsi"] < rsi) & (pdf["zscore"] < z)]["ticker"])[:5]
            out += [np.mean([price[t, i + hold] / price[t, i] - 1 for t in names]) / hold] * hold if names else [0.0]
        return [x - 0.0003 for x in out] if len(out) <= e - s else None

    points = list(product(*cfg.grid.values()))
    spans = {w: (20 * w, 20 * w + 40) for w in range(2)}
    got = {(r.window_id, r.grid_pos): r.sharpe for r in walk_forward.in_sample(df, grid, wins, strict=True).collect()}
    undefined = 0
    for (w, (s, e)), (g, p) in product(spans.items(), enumerate(points)):
        x = series(p, s, e)
        undefined += x is None
        want = None if x is None else (np.mean(x) / np.std(x, ddof=1) * 252**0.5 if np.std(x, ddof=1) > 1e-12 else 0.0)
        assert (got[w, g] is None) == (want is None) and (want is None or abs(got[w, g] - want) < 1e-6)
    assert 0 < undefined < len(got)
    chosen = walk_forward.best(walk_forward.in_sample(df, grid, wins, strict=True))
    pick = {r.window_id: r.grid_pos for r in chosen.collect()}
    oos = {}
    for r in walk_forward.out_of_sample(df, grid, wins, chosen, strict=True).collect():
        oos.setdefault(r.window_id, {})[r.date_idx] = r.ret
    for w, g in pick.items():
        x = series(points[g], 20 * w + 40, 20 * w + 60)
        have = [oos[w][k] for k in sorted(oos[w])]
        assert min(oos[w]) == 20 * w + 40 and (have == [None] * 20 if x is None else np.allclose(have, x))
