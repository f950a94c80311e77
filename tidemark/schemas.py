"""Declared schemas of the stage boundaries."""

OHLCV = ("open", "high", "low", "close", "volume")
BARS_RAW = "ticker string, date date, open double, high double, low double, close double, volume double"
CSV_BARS = "date string, open double, high double, low double, close double, volume double"
TRADES = "scenario_id string, ticker string, entry_date date, exit_date date, entry_price double, exit_price double, shares long, pnl double, pnl_pct double, holding_days int, exit_reason string"
EQUITY = "scenario_id string, date date, cash double, invested_value double, total_equity double, num_positions int, exposure_pct double"
