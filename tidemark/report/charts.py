"""Chart data as DataFrames, and a plain SVG line and bar renderer for collected rows."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import by_calendar, rolling
from ..operators import metrics, ranking, regime

THEME = {"background": "#11151c", "grid": "#2a3240", "text": "#d7dde8", "up": "#3fb68b", "down": "#e2574c", "line": "#5aa9e6", "second": "#f2b134"}


# ------------------------------------------------------------------------- chart data


def equity_chart(equity: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(date, equity, benchmark)."""
    e = equity.select("date", F.col("total_equity").alias("equity"))
    return e.join(benchmark.select("date", F.col("equity").alias("benchmark")), "date", "left") if benchmark is not None else e.withColumn("benchmark", F.lit(None).cast("double"))


def drawdown_chart(equity: DataFrame) -> DataFrame:
    """(date, drawdown, is_trough)."""
    d = metrics.drawdowns(equity.select("date", F.col("total_equity").alias("equity")))
    low = F.min(F.struct("drawdown", "date")).over(by_calendar().rowsBetween(-(1 << 31) + 1, (1 << 31) - 1))
    return d.select("date", "drawdown", (F.struct("drawdown", "date") == low).alias("is_trough"))


def signal_chart(signals: DataFrame, ticker: str) -> DataFrame:
    """Bars and bands of a ticker with marker heights and volume colours."""
    s = signals.where(F.col("ticker") == ticker)
    bands = [c for c in ("bb_upper", "bb_middle", "bb_lower") if c in s.columns]
    return s.select(
        "date", "open", "high", "low", "close", "volume", *bands, F.when(F.col("buy_signal"), F.col("low") * 0.98).alias("buy_marker"), F.when(F.col("sell_signal"), F.col("high") * 1.02).alias("sell_marker"),
        F.when(F.col("close") >= F.col("open"), THEME["up"]).otherwise(THEME["down"]).alias("volume_colour"),
    )


def rolling_sharpe_chart(returns: DataFrame, n: int = 63) -> DataFrame:
    """(date, positive, negative): the rolling ratio split at zero."""
    x = F.col("rolling_sharpe")
    return metrics.rolling_sharpe(returns, n).select("date", F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))).alias("positive"), F.when(x.isNotNull(), F.least(x, F.lit(0.0))).alias("negative"))


def monthly_heatmap(returns: DataFrame) -> DataFrame:
    """Monthly and yearly returns in per cent."""
    m = metrics.monthly_returns(returns)
    return m.select("year", *[(F.col(c) * 100).alias(c) for c in m.columns if c != "year"])


def distribution_chart(returns: DataFrame, bins: int = 80) -> tuple[DataFrame, DataFrame]:
    return metrics.histogram(returns, "ret", bins), metrics.return_stats(returns)


def ranked_table(rankings: DataFrame, date: str | None = None) -> DataFrame:
    """The top ten with a class of signal strength."""
    s = F.col("signal_strength")
    return ranking.top(rankings, 10, date).withColumn("strength_class", F.when(s >= 60, "strong").when(s >= 40, "medium").otherwise("weak")).orderBy("rank")


def regime_chart(market: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(date, close, sma_200) and the shaded segments."""
    line = market.select("date", "close", rolling(F.avg, F.col("close"), 200, w=by_calendar()).alias("sma_200"))
    return line, regime.segments(market)


# -------------------------------------------------------------------------- rendering


def svg_lines(rows: list[tuple], title: str, width: int = 900, height: int = 280) -> str:
    """Lines of rows (x, y1, y2, ...) over their index; missing values break a line."""
    series = list(zip(*[r[1:] for r in rows], strict=True)) if rows else []
    known = [v for s in series for v in s if v is not None]
    low, high = (min(known), max(known)) if known else (0.0, 1.0)
    span = (high - low) or 1.0
    n = max(1, len(rows) - 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" style="background:{THEME["background"]}">', f'<text x="10" y="20" fill="{THEME["text"]}">{escape(title)}</text>']
    for s, colour in zip(series, (THEME["line"], THEME["second"], THEME["up"]), strict=False):
        run: list[str] = []
        for i, v in [*enumerate(s), (0, None)]:
            if v is not None:
                run.append(f"{i / n * (width - 20) + 10:.1f},{height - 15 - (v - low) / span * (height - 50):.1f}")
            elif run:
                out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(run)}"/>')
                run = []
    return "".join([*out, "</svg>"])
