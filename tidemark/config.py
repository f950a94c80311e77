"""Settings. Only literals of these reach a plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


# Defaults of all settings.
@dataclass(frozen=True)
class DataConfig:
    start_date: str = "2018-01-01"
    end_date: str = "2026-05-23"
    chunk_size: int = 10
    chunk_delay: float = 2.0
    index_delay: float = 1.0
    max_retries: int = 3
    retry_delay: float = 5.0
    max_missing_pct: float = 0.20
    ffill_limit: int = 5


@dataclass(frozen=True)
class IndicatorConfig:
    rsi_period: int = 2
    sma_periods: tuple[int, ...] = (5, 10, 20, 50, 200)
    ema_periods: tuple[int, ...] = (9, 21, 50)
    atr_period: int = 14
    bb_period: int = 20
    bb_std: float = 2.0
    zscore_lookback: int = 20
    return_periods: tuple[int, ...] = (1, 5, 10, 20)
    volatility_lookback: int = 20
    volume_ma_period: int = 20
    percentile_lookback: int = 252


@dataclass(frozen=True)
class SignalConfig:
    rsi_buy: float = 10.0
    zscore_buy: float = -1.5
    relative_weakness_buy: float = -0.02
    volume_spike_buy: float = 1.5
    zscore_exit: float = 0.0
    rsi_exit: float = 70.0
    max_hold_days: int = 10
    atr_stop_multiplier: float = 2.0
    min_conditions: int = 3
    atr_median_lookback: int = 60
    atr_median_min: int = 20
    atr_multiple: float = 2.0


@dataclass(frozen=True)
class RegimeConfig:
    ma_period: int = 200
    fast_ma_period: int = 50
    buffer: float = 0.01
    confirm_days: int = 3
    vol_percentile: float = 0.75
    rv_lookback: int = 20
    rv_benchmark: int = 252
    rv_benchmark_min: int = 126
    allowed: tuple[str, ...] = ("strong_bull", "mild_bull")


@dataclass(frozen=True)
class BacktestConfig:
    initial_capital: float = 1_000_000.0
    buy_cost: float = 0.0015
    sell_cost: float = 0.0015
    slippage: float = 0.0005
    max_positions: int = 5
    risk_per_trade: float = 0.02
    least_cash: float = 1000.0
    fallback_atr: float = 0.02
    exit_fill: str = "close"  # or "next_open"


@dataclass(frozen=True)
class RankingConfig:
    rsi: float = 0.20
    zscore: float = 0.25
    relative_weakness: float = 0.20
    volume_exhaustion: float = 0.15
    atr: float = 0.10
    distance: float = 0.10

    def weights(self) -> dict[str, float]:
        return {"rsi_score": self.rsi, "zscore_score": self.zscore, "relative_weakness_score": self.relative_weakness, "volume_exhaustion_score": self.volume_exhaustion, "atr_norm_score": self.atr, "dist_from_ma_score": self.distance}

    def validate(self) -> None:
        total = sum(self.weights().values())
        if abs(total - 1) > 1e-6:
            raise ValueError(f"ranking weights add up to {total}, not 1")


@dataclass(frozen=True)
class WalkForwardConfig:
    in_sample: int = 252
    out_of_sample: int = 63
    step: int = 63
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {"rsi_buy_threshold": (5, 10, 15, 20), "zscore_buy_threshold": (-2.5, -2.0, -1.5, -1.0), "max_holding_days": (5, 7, 10), "atr_stop_multiplier": (1.5, 2.0, 2.5, 3.0)}
    )


@dataclass(frozen=True)
class Config:
    data: DataConfig = DataConfig()
    indicators: IndicatorConfig = IndicatorConfig()
    signals: SignalConfig = SignalConfig()
    regime: RegimeConfig = RegimeConfig()
    backtest: BacktestConfig = BacktestConfig()
    ranking: RankingConfig = RankingConfig()
    walk_forward: WalkForwardConfig = field(default_factory=WalkForwardConfig)
    root: Path = Path(".")

    def validate(self) -> None:
        self.ranking.validate()

    def resolve(self, relative: str) -> Path:
        return self.root / relative


TRADING_DAYS = 252
RISK_FREE = 0.06
