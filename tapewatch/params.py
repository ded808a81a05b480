"""Parameters of the operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Threshold:
    min_abs_return_bps: float
    min_abs_return_z: float
    min_volume_z: float
    min_abs_imbalance: float
    min_confirmations: int


@dataclass(frozen=True)
class WindowRule:
    seconds: int
    warning: Threshold
    critical: Threshold

    def __post_init__(self):
        if self.seconds < 15:
            raise ValueError("a window has at least 15 seconds")
        for name in ("min_abs_return_bps", "min_abs_return_z", "min_volume_z", "min_confirmations"):
            if getattr(self.critical, name) < getattr(self.warning, name):
                raise ValueError(f"critical {name} is below the warning one")


@dataclass(frozen=True)
class Grid:
    """Buckets, windows and the baseline; ticks are at the last millisecond of a bucket."""

    bucket_seconds: int = 5
    window_seconds: int = 60
    baseline_seconds: int = 3600
    min_points: int = 20
    max_points: int = 240
    max_gap_seconds: float = 15.0
    min_coverage: float = 0.8

    def __post_init__(self):
        if self.window_seconds % self.bucket_seconds:
            raise ValueError("the window is not a whole number of buckets")
        if self.stride_seconds % self.bucket_seconds:
            raise ValueError("half the window is not a whole number of buckets")
        if self.max_gap_seconds >= self.window_seconds:
            raise ValueError("the largest tolerated gap is shorter than the window")
        if self.min_points > self.possible_points:
            raise ValueError("the baseline is too short for so many points")

    @property
    def stride_seconds(self) -> int:
        return max(self.bucket_seconds, self.window_seconds // 2)

    @property
    def possible_points(self) -> int:
        return min(self.max_points, (self.baseline_seconds - self.window_seconds) // self.stride_seconds + 1)

    @property
    def bucket_ms(self) -> int:
        return self.bucket_seconds * 1000

    @property
    def n(self) -> int:
        """Buckets of a window."""
        return self.window_seconds // self.bucket_seconds

    @property
    def stride(self) -> int:
        return self.stride_seconds // self.bucket_seconds

    @property
    def baseline(self) -> int:
        return self.baseline_seconds // self.bucket_seconds


@dataclass(frozen=True)
class Rules:
    windows: tuple[WindowRule, ...]
    min_quote_volume: float = 0.0
    freshness_seconds: float = 30.0
    emergency_factor: float = 1.75
    liquidation_warning_usd: float = 1e6
    liquidation_critical_usd: float = 5e6
    liquidation_min_exchanges: int = 2
    spread_warning_bps: float = 20.0
    spread_critical_bps: float = 50.0
    spread_min_venues: int = 2
    venues: int = 3

    def __post_init__(self):
        if not self.windows:
            raise ValueError("no window")
        if len({w.seconds for w in self.windows}) != len(self.windows):
            raise ValueError("a window occurs twice")
        if self.liquidation_critical_usd < self.liquidation_warning_usd or self.spread_critical_bps < self.spread_warning_bps:
            raise ValueError("a critical threshold is below the warning one")
        if any(w.critical.min_confirmations > self.venues for w in self.windows) or self.spread_min_venues > self.venues:
            raise ValueError("more confirmations asked for than there are venues")

    @property
    def shortest(self) -> int:
        return min(w.seconds for w in self.windows)


@dataclass(frozen=True)
class Channel:
    name: str
    min_severity: str = "warning"
    enabled: bool = True

    def __post_init__(self):
        if self.min_severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.min_severity}")


SEVERITIES = ("info", "warning", "critical")


@dataclass(frozen=True)
class Gate:
    interval_seconds: float = 60.0
    hours: float = 1.0
    min_coverage: float = 0.98
    instances: tuple[str, ...] = field(default=("primary", "shadow"))
