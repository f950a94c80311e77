"""SQL equivalents of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from .queries import CFG, HALF, NUDGE

# ------------------------------------------------------------- common table expressions

BARS = """
line AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey AS k, l_linenumber AS n,
                l_extendedprice / l_quantity AS price, l_quantity AS q
         FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT ticker, date, arg_min(price, (k, n, price)) AS open, max(price) AS high, min(price) AS low,
                arg_max(price, (k, n, price)) AS close, CAST(sum(q) AS DOUBLE) AS volume
         FROM line GROUP BY ticker, date)"""
INDEX = BARS + """,
idx AS (SELECT date, avg(close) AS close FROM bars GROUP BY date)"""
VIX = """
vix AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS close FROM orders GROUP BY 1)"""
GAPPED = BARS + """,
gapped AS (SELECT ticker, date, CASE WHEN g THEN NULL ELSE open END AS open, high, low, CASE WHEN g THEN NULL ELSE close END AS close,
                  CASE WHEN b THEN -volume ELSE volume END AS volume
           FROM (SELECT *, (date_diff('day', DATE '1970-01-01', date) + ascii(substr(ticker, 7, 1))) % 11 = 0 AS g,
                        date_diff('day', DATE '1970-01-01', date) % 17 = 0 AS b FROM bars))"""

_W = "PARTITION BY ticker ORDER BY date"


def _win(agg: str, n: int, x: str = "close", least: int | None = None, shift: int = 0, by: str = _W) -> str:
    frame = f"OVER ({by} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg} {frame} END"


def r(x: str, digits: int = 4) -> str:
    return f"round({x} + {NUDGE}::DOUBLE, {digits}) + 0.0::DOUBLE"


def _ewm(x: str, alpha: float, least: int, table: str) -> str:
    """Column of table(ticker, date, x) with the exponential mean, by a list fold."""
    a = repr(float(alpha))
    return (
        f"CASE WHEN count({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING) >= {least} THEN "
        f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER ({_W} ROWS UNBOUNDED PRECEDING), lambda s, v: (1 - {a}::DOUBLE) * s + {a}::DOUBLE * v) END"
    )


#: Everything that signals need, at the default settings.
INDICATORS = INDEX + f""",
steps AS (SELECT *, close - lag(close) OVER ({_W}) AS step, lag(close) OVER ({_W}) AS c1 FROM bars),
parts AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gain, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS loss,
                 greatest(high - low, coalesce(abs(high - c1), 0), coalesce(abs(low - c1), 0)) AS tr, ln(close / nullif(c1, 0)) AS lr FROM steps),
means AS (SELECT *, {_ewm('gain', 0.5, 2, 'parts')} AS mg, {_ewm('loss', 0.5, 2, 'parts')} AS ml, {_ewm('tr', 1 / 14, 14, 'parts')} AS atr,
                 {_win('avg(close)', 20)} AS m20, {_win('stddev_pop(close)', 20)} AS p20,
                 {_win('avg(close)', 20, shift=1)} AS m20b, {_win('stddev_samp(close)', 20, shift=1)} AS s20b, {_win('avg(volume)', 20, 'volume')} AS v20,
                 close / nullif(lag(close, 1) OVER ({_W}), 0) - 1 AS return_1d, close / nullif(lag(close, 5) OVER ({_W}), 0) - 1 AS return_5d,
                 close / nullif(lag(close, 20) OVER ({_W}), 0) - 1 AS return_20d
          FROM parts),
ind AS (SELECT *, CASE WHEN ml IS NOT NULL THEN coalesce(100 - 100 / (1 + mg / nullif(ml, 0)), 100) END AS rsi, (close - m20b) / nullif(s20b, 0) AS zscore,
               volume / nullif(v20, 0) AS volume_spike, (close - m20) / nullif(m20, 0) AS dist, m20 - 2 * p20 AS bb_lower FROM means),
mkt AS (SELECT date, lag(r5) OVER (ORDER BY date) AS market_ret_5d, lag(r20) OVER (ORDER BY date) AS market_ret_20d
        FROM (SELECT date, close / nullif(lag(close, 5) OVER (ORDER BY date), 0) - 1 AS r5, close / nullif(lag(close, 20) OVER (ORDER BY date), 0) - 1 AS r20 FROM idx)),
rel AS (SELECT ind.*, market_ret_5d, market_ret_20d, return_5d - market_ret_5d AS relative_return_5d, return_20d - market_ret_20d AS relative_weakness,
               volume_spike * abs(CASE WHEN return_1d IS NOT NULL THEN least(return_1d, 0) END) AS volume_exhaustion
        FROM ind LEFT JOIN mkt USING (date))"""

_COMPONENTS = {"rsi_score": ("rsi", 1), "zscore_score": ("zscore", 1), "relative_weakness_score": ("relative_weakness", 1), "volume_exhaustion_score": ("volume_exhaustion", 0), "atr_norm_score": ("atr", 1), "dist_from_ma_score": ("dist", 1)}
_WEIGHTS = {"rsi_score": 0.20, "zscore_score": 0.25, "relative_weakness_score": 0.20, "volume_exhaustion_score": 0.15, "atr_norm_score": 0.10, "dist_from_ma_score": 0.10}


def _score(x: str, invert: int) -> str:
    w = "OVER (PARTITION BY date)"
    top = f"(max({x}) {w} - {x})" if invert else f"({x} - min({x}) {w})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN max({x}) {w} = min({x}) {w} THEN 0.5::DOUBLE ELSE {top} / nullif(max({x}) {w} - min({x}) {w}, 0) END"


_SCORES = ", ".join(f"{_score(x, i)} AS {s}" for s, (x, i) in _COMPONENTS.items())
_TOTAL = " + ".join(f"{s} * {w}::DOUBLE" for s, w in _WEIGHTS.items())
FEATURES = INDICATORS + f""",
feat AS (SELECT *, {_SCORES} FROM rel)"""

_C = "ORDER BY date"
REGIME = VIX + f""",
avgs AS (SELECT date, close, {_win('avg(close)', 200, shift=1, by=_C)} AS slow, {_win('avg(close)', 50, shift=1, by=_C)} AS fast, lag(close) OVER (ORDER BY date) AS c1 FROM idx),
vlow AS (SELECT date, coalesce(lag(close) OVER (ORDER BY date) < {_win('quantile_cont(close, 0.75)', 252, least=126, shift=1, by=_C)}, FALSE) AS flag FROM vix),
lowv AS (SELECT idx.date, coalesce(vlow.flag, FALSE) AS low_vol FROM idx ASOF LEFT JOIN vlow ON idx.date >= vlow.date),
lab AS (SELECT date, close, CASE WHEN c1 > slow * 1.01::DOUBLE AND fast > slow AND low_vol THEN 'strong_bull' WHEN c1 > slow * 1.01::DOUBLE THEN 'mild_bull'
               WHEN c1 < slow * 0.99::DOUBLE AND fast > slow THEN 'cautious' WHEN c1 < slow * 0.99::DOUBLE THEN 'bearish' END AS label FROM avgs JOIN lowv USING (date)),
rawr AS (SELECT date, close, last_value(label IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS raw_regime FROM lab),
chg AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) = 1 OR raw_regime IS DISTINCT FROM lag(raw_regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS ch FROM rawr),
runs AS (SELECT *, sum(ch) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM chg),
num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) + CASE WHEN run = 1 AND first_value(raw_regime) OVER (ORDER BY date) IS NOT NULL THEN 1 ELSE 0 END AS kk,
               first_value(raw_regime) OVER (ORDER BY date) AS f FROM runs),
reg AS (SELECT date, close, raw_regime, coalesce(last_value(CASE WHEN kk >= 3 AND raw_regime IS NOT NULL THEN raw_regime END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), f) AS regime FROM num)"""

SIGNALS = FEATURES + "," + REGIME + f""",
sg0 AS (SELECT feat.*, coalesce(reg.regime, 'unknown') AS regime, {_win('quantile_cont(atr, 0.5)', 60, 'atr', 20)} AS med FROM feat LEFT JOIN reg USING (date)),
sg1 AS (SELECT *, coalesce(rsi < 10, FALSE) AS c1_, coalesce(zscore < -1.5, FALSE) AS c2_, coalesce(close < bb_lower, FALSE) AS c3_, coalesce(relative_weakness < -0.02, FALSE) AS c4_,
               coalesce(volume_spike > 1.5, FALSE) AS c5_, regime IN ('strong_bull', 'mild_bull') AS c6_, coalesce(atr < 2.0 * med, FALSE) AS c7_ FROM sg0),
sg2 AS (SELECT *, c1_::INT + c2_::INT + c3_::INT + c4_::INT + c5_::INT + c6_::INT + c7_::INT AS conditions_count FROM sg1),
sig AS (SELECT *, conditions_count >= 3 AS buy_signal,
               CASE WHEN conditions_count < 3 THEN 0.0::DOUBLE WHEN zscore IS NULL OR rsi IS NULL THEN NULL
                    ELSE least(100, greatest(0, conditions_count / 7::DOUBLE * 100 + least(abs(least(zscore, 0)), 3) / 3 * 10 + greatest(0, least(10, 10 - rsi)))) END AS signal_strength,
               concat_ws(',', CASE WHEN c1_ THEN 'rsi_oversold' END, CASE WHEN c2_ THEN 'zscore_low' END, CASE WHEN c3_ THEN 'below_bb_lower' END, CASE WHEN c4_ THEN 'relative_weakness' END,
                         CASE WHEN c5_ THEN 'volume_spike' END, CASE WHEN c6_ THEN 'regime_ok' END, CASE WHEN c7_ THEN 'atr_ok' END) AS buy_conditions_met,
               coalesce(zscore > 0, FALSE) OR coalesce(rsi > 70, FALSE) AS sell_signal,
               CASE WHEN coalesce(zscore > 0, FALSE) THEN 'mean_reversion' WHEN coalesce(rsi > 70, FALSE) THEN 'rsi_exit' ELSE '' END AS exit_reason FROM sg2)"""

_RANKS = ", ".join(f"{_score(x, i)} AS {s}" for s, (x, i) in _COMPONENTS.items())
RANKED = SIGNALS + f""",
cand AS (SELECT date, ticker, signal_strength, {_RANKS} FROM (SELECT * FROM sig WHERE buy_signal)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite_score DESC NULLS LAST, ticker) AS rank FROM (SELECT *, {_TOTAL} AS composite_score FROM cand))"""

TRADES = SIGNALS + """,
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM sig)),
ent AS (SELECT s.ticker, s.date AS signal_date, c.nxt AS entry_date, c.i + 1 AS i0, b.open * (1 + 0.0015::DOUBLE + 0.0005::DOUBLE) AS entry_price, s.atr
        FROM sig s JOIN cal c ON s.date = c.date JOIN sig b ON b.ticker = s.ticker AND b.date = c.nxt WHERE s.buy_signal AND b.open > 0),
ent2 AS (SELECT *, entry_price - 2.0 * atr AS stop_loss FROM ent),
met AS (SELECT e.*, c.i, c.date AS d, coalesce(b.close, e.entry_price) AS px,
               CASE WHEN b.low <= e.stop_loss THEN 'atr_stop' WHEN bd(c.date) - bd(e.entry_date) >= 10 THEN 'time_stop' WHEN b.sell_signal THEN b.exit_reason END AS why
        FROM ent2 e JOIN cal c ON c.i BETWEEN e.i0 AND e.i0 + 16 LEFT JOIN sig b ON b.ticker = e.ticker AND b.date = c.date),
tr AS (SELECT ticker, signal_date, entry_date, entry_price, stop_loss, min(i) FILTER (why IS NOT NULL) AS x FROM met GROUP BY ALL),
trades AS (SELECT t.ticker, t.signal_date, t.entry_date, t.entry_price, t.stop_loss, m.d AS exit_date, m.px * (1 - 0.0015::DOUBLE - 0.0005::DOUBLE) AS exit_price,
                  date_diff('day', t.entry_date, m.d) AS holding_days, m.px * (1 - 0.0015::DOUBLE - 0.0005::DOUBLE) / t.entry_price - 1 AS pnl_pct, m.why AS exit_reason
           FROM tr t LEFT JOIN met m ON m.ticker = t.ticker AND m.signal_date = t.signal_date AND m.i = t.x)"""


def _bd(x: str) -> str:
    n = f"date_diff('day', DATE '1970-01-05', {x})"
    return f"(floor({n} / 7.0)::BIGINT * 5 + least((({n} % 7) + 7) % 7, 5))"


TRADES = TRADES.replace("bd(c.date)", _bd("c.date")).replace("bd(e.entry_date)", _bd("e.entry_date"))

RETURNS = INDEX + """,
ret AS (SELECT date, ret FROM (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS ret FROM idx) WHERE ret IS NOT NULL)"""
DRAW = INDEX + """,
dd AS (SELECT date, close, peak, (close - peak) / nullif(peak, 0) AS drawdown FROM (SELECT date, close, max(close) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM idx))"""
_CAGR = "CASE WHEN count(close) >= 2 AND arg_min(close, date) > 0 THEN pow(arg_max(close, date) / arg_min(close, date), 252.0::DOUBLE / count(close)) - 1 ELSE 0 END"
_X = "(ret - 0.06::DOUBLE / 252)"

WALK = CFG.walk_forward
_p, _z, _h, _m = (WALK.grid[k] for k in ("rsi_buy_threshold", "zscore_buy_threshold", "max_holding_days", "atr_stop_multiplier"))
WALKED = INDICATORS + f""",
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ind)),
nn AS (SELECT count(*) AS n FROM cal),
win AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s, s + {WALK.in_sample} AS m, s + {WALK.in_sample + WALK.out_of_sample} AS e
        FROM (SELECT unnest(range(0, (n - {WALK.in_sample + WALK.out_of_sample} + 1)::BIGINT, {WALK.step})) AS s FROM nn)),
grid AS (SELECT row_number() OVER (ORDER BY a, b, c, o) - 1 AS g, p, z, h
         FROM (SELECT unnest({[float(x) for x in _p]}::DOUBLE[]) AS p, unnest(range({len(_p)})) AS a),
              (SELECT unnest({[float(x) for x in _z]}::DOUBLE[]) AS z, unnest(range({len(_z)})) AS b),
              (SELECT unnest({[int(x) for x in _h]}::INT[]) AS h, unnest(range({len(_h)})) AS c),
              (SELECT unnest(range({len(_m)})) AS o)),
pnl AS (SELECT ticker, i, close, rsi, zscore FROM ind JOIN cal USING (date)),
hit AS (SELECT g, h, i, ticker, close, row_number() OVER (PARTITION BY g, i ORDER BY ticker) AS k FROM pnl, grid WHERE rsi < p AND zscore < z),
fwd AS (SELECT hit.g, hit.h, hit.i, avg(x.close / hit.close - 1) AS ret FROM hit JOIN pnl x ON x.ticker = hit.ticker AND x.i = hit.i + hit.h WHERE k <= 5 GROUP BY ALL),
spans AS (SELECT w, 0 AS test, s, m AS e FROM win UNION ALL SELECT w, 1, m, e FROM win),
put AS (SELECT w, test, g, i + unnest(range(h)) AS i, ret / h AS ret FROM fwd JOIN spans ON i >= s AND i + h < e),
day AS (SELECT w, test, g, i, avg(ret) AS ret FROM put GROUP BY ALL),
alls AS (SELECT w, test, g, unnest(range(s, e)) AS i FROM spans, grid),
wret AS (SELECT alls.*, coalesce(day.ret, 0) - 0.0003::DOUBLE AS ret FROM alls LEFT JOIN day USING (w, test, g, i)),
sh AS (SELECT w, g, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) ELSE 0 END AS sharpe FROM wret WHERE test = 0 GROUP BY ALL),
best AS (SELECT w, g, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY round(sharpe, 9) DESC NULLS LAST, g) AS k FROM sh) WHERE k = 1),
oos AS (SELECT wret.w, wret.g, i, ret FROM wret JOIN best USING (w, g) WHERE test = 1)"""


def _with(cte: str, select: str) -> str:
    return f"WITH {cte.strip()}\n{select}"


def _scalar(table: str, *columns: str) -> str:
    return f"SELECT ticker, date, {', '.join(columns)} FROM {table}"


_FILLED = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {c}" for c in ("open", "high", "low", "close", "volume"))
_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in ("open", "high", "low", "close", "volume"))
FILLED = GAPPED + f""",
filled AS (SELECT ticker, date, nb, {_FILLED} FROM (SELECT *, {_NULLS} AS nb FROM gapped)),
flag AS (SELECT *, {_NULLS} AS na, coalesce(high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0, FALSE) AND ({_NULLS}) = 0 AS kept FROM filled),
stats AS (SELECT ticker, count(*) AS raw_rows, sum(nb - na)::BIGINT AS gaps_filled, count(*) FILTER (na = 0 AND NOT kept) AS invalid_rows_removed, count(*) FILTER (kept) AS final_rows,
                 sum(nb) / (count(*) * 5)::DOUBLE AS missing_pct, 1 - count(*) FILTER (kept) / count(*)::DOUBLE AS removed_pct FROM flag GROUP BY ticker)"""

_OHLCV_R = ", ".join(f"{r(c)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_IND_ALL = {
    "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", **{f"sma_{p}": _win("avg(close)", p) for p in (5, 10, 20, 50, 200)},
    "bb_upper": "m20 + 2 * p20", "bb_middle": "m20", "bb_lower": "bb_lower", **{f"return_{p}d": f"close / nullif(lag(close, {p}) OVER ({_W}), 0) - 1" for p in (1, 5, 10, 20)},
    "zscore": "zscore", "volume_spike": "volume_spike", "dist_from_ma_20": "dist",
    "percentile_rank_252": f"(close - {_win('min(close)', 252)}) / nullif({_win('max(close)', 252)} - {_win('min(close)', 252)}, 0) * 100",
    "bb_pct_b": "(close - bb_lower) / nullif(m20 + 2 * p20 - bb_lower, 0)", "volatility_ann": f"{_win('stddev_samp(lr)', 20, 'lr')} * sqrt(252.0::DOUBLE)", "rsi_2": "rsi",
    **{f"ema_{p}": _ewm("close", 2 / (p + 1), p, "ind") for p in (9, 21, 50)}, "atr_14": "atr", "rsi": "rsi", "atr": "atr", "distance_from_sma_20": "dist",
}

ORACLE_SQL: dict[str, str] = {
    "bars_daily": _with(BARS, f"SELECT ticker, date, {_OHLCV_R} FROM bars"),
    "bars_hourly": f"WITH e AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, (ts, event_id, value) AS o, value AS price FROM events), b AS (SELECT ticker, date, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, count(*)::DOUBLE AS volume FROM e GROUP BY ALL) SELECT ticker, date::TIMESTAMP AS date, {_OHLCV_R} FROM b",
    "index_daily": _with(INDEX, f"SELECT date, {r('close')} AS close FROM idx"),
    "vix_daily": _with(VIX, f"SELECT date, {r('close')} AS close FROM vix"),
    "clean_ffill": _with(FILLED, f"SELECT ticker, date, {_OHLCV_R} FROM filled"),
    "clean_validate": _with(GAPPED, f"SELECT ticker, date, {_OHLCV_R} FROM gapped WHERE high >= low AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0"),
    "clean_stats": _with(FILLED, f"SELECT ticker, raw_rows, gaps_filled, invalid_rows_removed, final_rows, {r('missing_pct')} AS missing_pct, {r('removed_pct')} AS removed_pct, removed_pct <= 0.2 AS accepted, CASE WHEN removed_pct > 0.2 THEN 'too many rows missing or invalid' END AS rejection_reason FROM stats"),
    "clean_quality_gate": _with(FILLED, f"SELECT ticker, date, {_OHLCV_R} FROM flag WHERE kept AND ticker IN (SELECT ticker FROM stats WHERE removed_pct <= 0.2)"),
    "clean_report": _with(FILLED, "SELECT count(*) AS tickers_processed, count(*) FILTER (removed_pct <= 0.2) AS tickers_kept, count(*) FILTER (removed_pct > 0.2) AS tickers_dropped FROM stats"),
    "null_shares": _with(GAPPED, "SELECT " + ", ".join(f"{r(f'avg(({c} IS NULL)::INT::DOUBLE) * 100')} AS {c}" for c in ("ticker", "date", "open", "high", "low", "close", "volume")) + " FROM gapped"),
    "file_names": _with(BARS, "SELECT ticker || '&/x' AS ticker, ticker || '__x.csv' AS file_name, ticker || '__x' AS back FROM (SELECT DISTINCT ticker FROM bars)"),
    "sma": _with(BARS, _scalar("bars", *[f"{r(_win('avg(close)', p))} AS sma_{p}" for p in (5, 10, 20, 50, 200)])),
    "bollinger": _with(BARS + f", b AS (SELECT ticker, date, close, {_win('avg(close)', 20)} AS m, {_win('stddev_pop(close)', 20)} AS s FROM bars)", _scalar("b", f"{r('m + 2 * s')} AS bb_upper", f"{r('m')} AS bb_middle", f"{r('m - 2 * s')} AS bb_lower", f"{r('(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)')} AS bb_pct_b")),
    "returns": _with(BARS, _scalar("bars", *[f"{r(f'close / nullif(lag(close, {p}) OVER ({_W}), 0) - 1')} AS return_{p}d" for p in (1, 5, 10, 20)])),
    "volatility": _with(INDICATORS, _scalar("ind", f"{r(_win('stddev_samp(lr)', 20, 'lr') + ' * sqrt(252.0::DOUBLE)')} AS volatility_ann")),
    "zscore": _with(INDICATORS, _scalar("ind", f"{r('zscore')} AS zscore")),
    "volume_spike": _with(INDICATORS, _scalar("ind", f"{r('volume_spike')} AS volume_spike")),
    "dist_ma": _with(INDICATORS, _scalar("ind", f"{r('dist')} AS dist_from_ma_20")),
    "range_pct": _with(BARS, _scalar("bars", f"{r(_IND_ALL['percentile_rank_252'])} AS percentile_rank_252")),
    "rsi": _with(INDICATORS, _scalar("ind", f"{r('rsi')} AS rsi_2")),
    "ema": _with(BARS, _scalar("bars", *[f"{r(_ewm('close', 2 / (p + 1), p, 'bars'))} AS ema_{p}" for p in (9, 21, 50)])),
    "atr": _with(INDICATORS, _scalar("ind", f"{r('atr')} AS atr_14")),
    "indicators_all": _with(INDICATORS + ", wide AS (SELECT ticker, " + ", ".join(f"{x} AS {c}" for c, x in _IND_ALL.items()) + " FROM ind)", "SELECT ticker, count(*) AS bars, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in _IND_ALL) + " FROM wide GROUP BY ticker"),
    "annualised": _with(BARS + f", x AS (SELECT ticker, (close / nullif(lag(close) OVER ({_W}), 0) - 1) / 1000 AS q FROM bars)", f"SELECT ticker, {r('CASE WHEN count(q) = 0 THEN 0 ELSE pow(product(1 + q), 252.0::DOUBLE / count(q)) - 1 END')} AS annual_return, {r('stddev_samp(q) * sqrt(252.0::DOUBLE)')} AS annual_volatility FROM x GROUP BY ticker"),
    "relative_features": _with(INDICATORS, _scalar("rel", *[f"{r(c)} AS {c}" for c in ("market_ret_5d", "market_ret_20d", "relative_return_5d", "relative_weakness")])),
    "cs_zscore": _with(INDICATORS, _scalar("ind", *[f"{r(f'({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0)')} AS cs_zscore_{c}" for c in ("zscore", "volume_spike")])),
    "cs_percentile": _with(INDICATORS, _scalar("ind", r("CASE WHEN zscore IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY zscore NULLS LAST) + (count(*) OVER (PARTITION BY date, zscore) - 1) / 2.0::DOUBLE) / count(zscore) OVER (PARTITION BY date) * 100 END") + " AS cs_percentile_zscore")),
    "volume_exhaustion": _with(INDICATORS, _scalar("rel", f"{r('volume_exhaustion')} AS volume_exhaustion")),
    "component_scores": _with(FEATURES, _scalar("feat", *[f"{r(s)} AS {s}" for s in _COMPONENTS])),
    "mean_reversion_score": _with(FEATURES, _scalar("feat", f"{r(_TOTAL)} AS mean_reversion_score")),
    "winsorize": _with(BARS + ", p AS (SELECT quantile_cont(close, 0.01) AS a, quantile_cont(close, 0.99) AS b FROM bars)", f"SELECT ticker, date, {r('greatest(a, least(b, close))')} AS close FROM bars, p"),
    "minmax": _with(BARS + ", p AS (SELECT min(close) AS a, max(close) AS b FROM bars)", f"SELECT ticker, date, {r('(close - a) / nullif(b - a, 0)')} AS close FROM bars, p"),
    "pivot_close": _with(BARS, "SELECT date, " + ", ".join("{} AS \"Brand#{}\"".format(r("avg(close) FILTER (ticker = 'Brand#%d')" % i), i) for i in range(1, 26)) + " FROM bars GROUP BY date"),
    "regime_raw": _with(INDEX + "," + REGIME, "SELECT date, raw_regime FROM reg"),
    "regime_confirmed": _with(INDEX + "," + REGIME, f"SELECT date, regime, {r('CASE regime WHEN $$bearish$$ THEN 0 WHEN $$cautious$$ THEN 1 / 3::DOUBLE WHEN $$mild_bull$$ THEN 2 / 3::DOUBLE WHEN $$strong_bull$$ THEN 1 END::DOUBLE')} AS strength, coalesce(regime IN ('strong_bull', 'mild_bull'), FALSE) AS allowed FROM reg"),
    "regime_vix_asof": _with(INDEX + "," + REGIME, "SELECT date, low_vol FROM lowv"),
    "regime_realised": _with(INDEX + f", q AS (SELECT date, ln(close / nullif(lag(close) OVER (ORDER BY date), 0)) AS x FROM idx), v AS (SELECT date, {_win('stddev_samp(x)', 20, 'x', by=_C)} * sqrt(252.0::DOUBLE) AS rv FROM q)", f"SELECT date, coalesce(lag(rv) OVER (ORDER BY date) < {_win('quantile_cont(rv, 0.75)', 252, 'rv', 126, 1, _C)}, FALSE) AS low_vol FROM v"),
    "regime_distribution": _with(INDEX + "," + REGIME, f"SELECT regime, count(*) AS days, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM reg GROUP BY regime"),
    "regime_segments": _with(INDEX + "," + REGIME + ", c2 AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) = 1 OR regime IS DISTINCT FROM lag(regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS h FROM reg), r2 AS (SELECT *, sum(h) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM c2)", "SELECT run_id, regime, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM r2 GROUP BY ALL"),
    "buy_signals": _with(SIGNALS, f"SELECT ticker, date, conditions_count::BIGINT AS conditions_count, buy_signal, {r('signal_strength', 3)} AS signal_strength, buy_conditions_met FROM sig"),
    "exit_signals": _with(SIGNALS, "SELECT ticker, date, sell_signal, exit_reason FROM sig"),
    "signal_frequency": _with(SIGNALS, "SELECT date, count(*) FILTER (buy_signal) AS buy_signals, count(*) AS tickers FROM sig GROUP BY date"),
    "rank_candidates": _with(RANKED, f"SELECT date, rank, ticker, {r('composite_score', 3)} AS composite_score FROM ranked"),
    "top_candidates": _with(RANKED, f"SELECT date, rank, ticker, {r('composite_score', 3)} AS composite_score FROM ranked WHERE date = (SELECT max(date) FROM ranked) AND rank <= 5"),
    "latest_per_ticker": _with(BARS, f"SELECT ticker, date, {_OHLCV_R} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"),
    "most_stretched": _with(INDICATORS, f"SELECT ticker, date, {r('close')} AS close, {r('zscore')} AS zscore, {r('volume_spike')} AS volume_spike FROM (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) x WHERE x.zscore IS NOT NULL ORDER BY x.zscore, ticker LIMIT 5"),
    "universe_diff": f"WITH t AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_size AS symbol, CAST(l_shipdate AS DATE) < DATE '{HALF}' AS early FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT symbol FROM t WHERE early), l AS (SELECT symbol FROM t WHERE NOT early) SELECT symbol, 'added' AS status FROM (SELECT * FROM l EXCEPT SELECT * FROM s) UNION ALL SELECT symbol, 'removed' FROM (SELECT * FROM s EXCEPT SELECT * FROM l) UNION ALL SELECT symbol, 'common' FROM (SELECT * FROM s INTERSECT SELECT * FROM l)",
    "ticker_counts": _with(BARS, "SELECT ticker, count(*) AS bars, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker"),
    "trading_calendar": _with(BARS, "SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars)"),
    "business_day_counts": f"WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 40)::INT AS b FROM orders) SELECT o_orderkey, a, {_bd('b')} - {_bd('a')} AS days FROM o",
    "parsed_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders",
    "trades_uncoupled": _with(TRADES, f"SELECT ticker, signal_date, entry_date, {r('entry_price', 3)} AS entry_price, {r('stop_loss', 3)} AS stop_loss, exit_date, {r('exit_price', 3)} AS exit_price, holding_days, {r('pnl_pct', 3)} AS pnl_pct, exit_reason FROM trades"),
    "cagr": _with(INDEX, f"SELECT {r(_CAGR)} AS cagr, {r('arg_max(close, date) / arg_min(close, date) - 1')} AS total_return FROM idx"),
    "sharpe": _with(RETURNS, f"SELECT {r(f'avg({_X}) / stddev_samp({_X}) * sqrt(252.0::DOUBLE)')} AS sharpe, {r(f'avg({_X}) / stddev_samp(least({_X}, 0)) * sqrt(252.0::DOUBLE)')} AS sortino FROM ret"),
    "drawdown": _with(DRAW, f"SELECT date, {r('drawdown')} AS drawdown FROM dd"),
    "max_drawdown": _with(DRAW + f", t AS (SELECT date AS trough_date, peak AS level, drawdown AS max_drawdown FROM dd ORDER BY drawdown, date LIMIT 1), g AS (SELECT {_CAGR} AS cagr FROM idx)", f"SELECT {r('max_drawdown')} AS max_drawdown, trough_date, max(dd.date) FILTER (dd.date <= trough_date AND close = level) AS peak_date, CASE WHEN count(*) FILTER (dd.date > trough_date AND close >= level) >= 2 THEN min(dd.date) FILTER (dd.date > trough_date AND close >= level) END AS recovery_date, {r('CASE WHEN abs(max_drawdown) < 1e-10 THEN 0 ELSE any_value(cagr) / abs(max_drawdown) END')} AS calmar FROM dd, t, g GROUP BY max_drawdown, trough_date"),
    "rolling_sharpe": _with(RETURNS + f", x AS (SELECT date, {_X} AS x FROM ret)", f"SELECT date, {r('(' + _win('avg(x)', 63, 'x', by=_C) + ') / nullif(' + _win('stddev_samp(x)', 63, 'x', by=_C) + ', 0) * sqrt(252.0::DOUBLE)')} AS rolling_sharpe FROM x"),
    "monthly_returns": _with(RETURNS, "SELECT year(date) AS year, " + ", ".join(f"{r(f'product(1 + ret) FILTER (month(date) = {i}) - 1')} AS {m}" for i, m in enumerate(_MONTHS, 1)) + f", {r('product(1 + ret) - 1')} AS YTD FROM ret GROUP BY 1"),
    "return_stats": _with(RETURNS, f"SELECT count(*) AS n, {r('avg(ret)')} AS mean, {r('median(ret)')} AS median, {r('stddev_samp(ret)')} AS std, {r('skewness(ret)')} AS skewness, {r('kurtosis(ret)')} AS kurtosis FROM ret"),
    "return_histogram": _with(RETURNS + ", b AS (SELECT min(ret) AS a, (max(ret) - min(ret)) / 80 AS w FROM ret), k AS (SELECT least(80, floor((ret - a) / w)::BIGINT + 1) AS bin, a, w FROM ret, b)", f"SELECT bin, {r('a + (bin - 1) * w')} AS low, {r('a + bin * w')} AS high, count(*) AS n FROM k GROUP BY bin, a, w"),
    "benchmark_equity": _with(INDEX, f"SELECT date, {r('1000000.0::DOUBLE * close / first_value(close) OVER (ORDER BY date)', 2)} AS equity FROM idx"),
    "trade_metrics": _with(TRADES, f"SELECT {r('avg((pnl_pct > 0)::INT::DOUBLE)')} AS win_rate, {r('sum(pnl_pct) FILTER (pnl_pct > 0) / abs(sum(pnl_pct) FILTER (pnl_pct < 0))')} AS profit_factor, {r('avg(holding_days::DOUBLE)')} AS avg_holding_days FROM trades WHERE exit_date IS NOT NULL"),
    "exit_breakdown": _with(TRADES, f"SELECT exit_reason, count(*) AS trades, {r('avg(pnl_pct) FILTER (pnl_pct > 0)')} AS avg_win, {r('avg(pnl_pct) FILTER (pnl_pct <= 0)')} AS avg_loss, {r('avg((pnl_pct > 0)::INT::DOUBLE) * 100')} AS win_pct FROM trades WHERE exit_date IS NOT NULL GROUP BY exit_reason"),
    "wfo_windows": _with(WALKED, "SELECT w AS window_id, s AS train_start, m AS train_end, m AS test_start, e AS test_end FROM win"),
    "wfo_grid": "WITH a AS (SELECT unnest([5, 10, 15, 20]::DOUBLE[]) AS x, unnest(range(4)) AS i), b AS (SELECT unnest([-2.5, -2.0, -1.5, -1.0]::DOUBLE[]) AS x, unnest(range(4)) AS i), c AS (SELECT unnest([5, 7, 10]::DOUBLE[]) AS x, unnest(range(3)) AS i), d AS (SELECT unnest([1.5, 2.0, 2.5, 3.0]::DOUBLE[]) AS x, unnest(range(4)) AS i) SELECT a.i * 48 + b.i * 12 + c.i * 4 + d.i AS grid_pos, a.x AS rsi_buy_threshold, b.x AS zscore_buy_threshold, c.x AS max_holding_days, d.x AS atr_stop_multiplier FROM a, b, c, d",
    "wfo_insample": _with(WALKED, f"SELECT w AS window_id, g AS grid_pos, {r('sharpe')} AS sharpe FROM sh"),
    "wfo_best": _with(WALKED, f"SELECT w AS window_id, g AS grid_pos, {r('sharpe')} AS sharpe FROM best"),
    "wfo_oos": _with(WALKED, f"SELECT w AS window_id, g AS grid_pos, i AS date_idx, {r('ret', 6)} AS ret FROM oos"),
    "wfo_summary": _with(
        WALKED + ", per AS (SELECT w, CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) ELSE 0 END AS o FROM oos GROUP BY w), mm AS (SELECT avg(sharpe) AS mi, avg(o) AS mo, count(*) AS n FROM best JOIN per USING (w)), q AS (SELECT avg(%s) / stddev_samp(%s) * sqrt(252.0::DOUBLE) AS a, avg(%s) / stddev_samp(least(%s, 0)) * sqrt(252.0::DOUBLE) AS b, product(1 + ret) - 1 AS c, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS d FROM oos)" % (_X, _X, _X, _X),
        f"SELECT {r('a')} AS oos_sharpe, {r('b')} AS oos_sortino, {r('log10(1 + c)')} AS oos_total_return, {r('d')} AS oos_annual_vol, {r('mi')} AS mean_is_sharpe, {r('mo')} AS mean_oos_sharpe, n AS windows, {r('mi / mo')} AS overfitting_ratio, CASE WHEN mi / mo < 2 THEN 'ROBUST' WHEN mi / mo < 3 THEN 'MARGINAL' ELSE 'OVERFITTING' END AS status FROM mm, q",
    ),
    "stream_hourly_bars": f"WITH e AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS h, (ts, event_id, value) AS o, value AS price FROM events) SELECT ticker, h::TIMESTAMP AS bar_start, {r('arg_min(price, o)')} AS open, {r('max(price)')} AS high, {r('min(price)')} AS low, {r('arg_max(price, o)')} AS close, count(*)::DOUBLE AS volume, count(*) AS ticks FROM e GROUP BY ALL",
}
