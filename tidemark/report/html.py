"""Text and HTML reports of a backtest."""

from __future__ import annotations

from datetime import date
from html import escape
from pathlib import Path

from ..plans.research import Backtest
from . import charts

#: Metrics besides those with "pct" in their name that read as percentages.
PERCENT = ("total_return", "cagr", "annual_volatility", "max_drawdown", "win_rate", "exposure")


def shown(name: str, value) -> str:  # noqa: ANN001
    if value is None:
        return "-"
    if isinstance(value, float):
        return f"{value * 100:.2f}%" if name in PERCENT or "pct" in name else f"{value:,.2f}"
    return value.isoformat() if isinstance(value, date) else str(value)


def title(name: str) -> str:
    return name.replace("_", " ").title()


def metrics_text(row: dict) -> str:
    wide = max(map(len, row), default=0)
    return "\n".join(f"{title(k):<{wide}}  {shown(k, v)}" for k, v in row.items())


def table(rows: list[dict]) -> str:
    if not rows:
        return "<p>None</p>"
    head = "".join(f"<th>{escape(title(k))}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape(shown(k, v))}</td>" for k, v in r.items()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def write_report(result: Backtest, folder: str, name: str = "report.html", trades: int = 50) -> Path:
    """A page with the equity and drawdown charts, all metrics and the last trades. The
    equity curve (a row per date) and ``trades`` trades are collected, nothing larger."""
    equity = [tuple(r) for r in charts.equity_chart(result.equity, result.benchmark).orderBy("date").collect()]
    fall = [tuple(r)[:2] for r in charts.drawdown_chart(result.equity).orderBy("date").collect()]
    row = result.metrics.first().asDict()
    last = [r.asDict() for r in result.trades.orderBy("exit_date", "ticker").tail(trades)]
    page = "".join(
        [
            "<!doctype html><html><head><meta charset='utf-8'><title>Backtest</title></head><body>",
            charts.svg_lines(equity, "Equity"), charts.svg_lines(fall, "Drawdown"), "<h2>Metrics</h2>", table([{"metric": title(k), "value": shown(k, v)} for k, v in row.items()]),
            "<h2>Last trades</h2>", table(last), "</body></html>",
        ]
    )
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(page, encoding="utf-8")
    return path
