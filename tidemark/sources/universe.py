"""Universes are tables of symbols: given as a file or a list, by default the list below."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The service's symbols of the three index series.
INDEXES = {"nifty50": "^NSEI", "nifty_bank": "^NSEBANK", "india_vix": "^INDIAVIX"}
# The symbols of the default universe.
SYMBOLS = (
    "ADANIENT", "ADANIPORTS", "APOLLOHOSP", "ASIANPAINT", "AXISBANK", "BAJAJ-AUTO", "BAJFINANCE", "BAJAJFINSV", "BEL", "BHARTIARTL",
    "CIPLA", "COALINDIA", "DRREDDY", "EICHERMOT", "GRASIM", "HCLTECH", "HDFCBANK", "HDFCLIFE", "HINDALCO", "HINDUNILVR",
    "ICICIBANK", "INFY", "INDIGO", "ITC", "JSWSTEEL", "JIOFIN", "KOTAKBANK", "LT", "M&M", "MARUTI",
    "MAXHEALTH", "NTPC", "NESTLEIND", "ONGC", "POWERGRID", "RELIANCE", "SBILIFE", "SHRIRAMFIN", "SBIN", "SUNPHARMA",
    "TCS", "TATACONSUM", "TATAMOTORS", "TATASTEEL", "TECHM", "TITAN", "TRENT", "ULTRACEMCO", "WIPRO", "HEROMOTOCO",
)
#: A listing with fewer symbols is not taken for a universe.
LEAST_LISTED = 40


def universe(spark: SparkSession, symbols: list[str] | tuple[str, ...] = SYMBOLS, suffix: str = "") -> DataFrame:
    return spark.createDataFrame([(s + suffix,) for s in sorted(set(symbols))], "symbol string")


class _Tables(HTMLParser):
    """The rows of every table of a page, as lists of cell texts; an inner table's rows go
    to the table around it."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.depth, self.inside = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif tag == "tr" and self.depth:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.depth and self.tables[-1]:
            self.tables[-1][-1].append("")
            self.inside = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        if tag in ("td", "th", "tr", "table"):
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.tables[-1][-1][-1] += data


def listed_symbols(page: str) -> list[str]:
    """The ``Symbol`` column of the first table of a page that has one with enough symbols."""
    parser = _Tables()
    parser.feed(page)
    for rows in parser.tables:
        head = [x.strip().lower() for x in rows[0]] if rows else []
        if "symbol" in head:
            at = head.index("symbol")
            found = sorted({r[at].strip() for r in rows[1:] if len(r) > at and r[at].strip()})
            if len(found) >= LEAST_LISTED:
                return found
    raise RuntimeError(f"no table of the page lists {LEAST_LISTED} symbols")


def read_universe(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """The ``Symbol`` column of a listing: a CSV file or a saved HTML page (one page, parsed
    on the driver)."""
    if path.lower().endswith((".html", ".htm")):
        return universe(spark, listed_symbols(spark.read.text(path, wholetext=True).first()[0]), suffix)
    df = spark.read.option("header", True).csv(path)
    column = next(c for c in df.columns if c.strip().lower() == "symbol")
    out = df.select(F.concat(F.trim(F.col(column)), F.lit(suffix)).alias("symbol")).where("symbol <> ''").distinct()
    if out.count() < LEAST_LISTED:
        raise RuntimeError(f"{path} lists fewer than {LEAST_LISTED} symbols")
    return out
