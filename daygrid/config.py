"""Settings passed to operators. Plain dataclasses, no files."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Period:
    """A closed day range and its two split boundaries."""

    start: date
    end: date
    train_end: date
    val_end: date

    def __post_init__(self) -> None:
        if not self.start <= self.train_end < self.val_end <= self.end:
            raise ValueError(f"split dates are not ordered inside the period: {self}")

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class PanelSettings:
    period: Period
    top_n: int = 10
    exclude: tuple[int, ...] = ()
    lags: tuple[int, ...] = (1, 2, 3, 7, 14)
    rolling: tuple[int, ...] = (7,)


@dataclass(frozen=True)
class SeriesSettings:
    period: Period
    lags: tuple[int, ...] = (1, 7, 14)
    rolling: tuple[int, ...] = (7,)
    harmonics: int = 3
    shock_quantile: float = 0.90


@dataclass(frozen=True)
class TimeWindows:
    """Hours that define the commute and leisure segments, shared by all modes."""

    weekday_morning: tuple[int, ...] = (7, 8, 9)
    weekend_midday: tuple[int, ...] = (11, 12, 13, 14, 15)


@dataclass(frozen=True)
class SearchSettings:
    draws: int = 20
    folds: int = 5
    seed: int = 42


# Study periods and split dates.
PANEL_DEFAULTS = PanelSettings(
    Period(date(2022, 1, 1), date(2024, 12, 31), date(2023, 12, 31), date(2024, 6, 30)),
    exclude=(132, 138),
)
SERIES_DEFAULTS = SeriesSettings(
    Period(date(2022, 1, 1), date(2023, 12, 31), date(2023, 6, 30), date(2023, 9, 30))
)
SECOND_MODE_DEFAULTS = SeriesSettings(
    Period(date(2023, 6, 1), date(2024, 8, 31), date(2024, 5, 31), date(2024, 7, 15))
)
# Search ranges (low, high) per model family.
PANEL_RIDGE_ALPHA = (1e-3, 1e4)
SERIES_RIDGE_ALPHA = (1e-2, 1e4)
PANEL_BOOSTED = {"trees": (50, 499), "depth": (2, 8), "rate": (0.01, 0.3), "share": (0.6, 1.0)}
SERIES_BOOSTED = {"trees": (50, 399), "depth": (2, 6), "rate": (0.01, 0.3), "share": (0.6, 1.0)}
SERIES_FOREST = {"trees": (100, 499), "depth": (2, 11), "leaf": (1, 19)}
BOOTSTRAP_REPS = 5000
BOOTSTRAP_BLOCK = 14
