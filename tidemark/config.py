"""Settings of the time-series operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Channel:
    """A channel of the signal, the source column it comes from, and the column of its quality flag."""

    name: str
    column: str
    flag: str | None = None


#: The source's channels in order.
CHANNELS = (
    Channel("temperature", "temp", "temp_quality"),
    Channel("relative_humidity", "rhum"),
    Channel("pressure", "msl", "pressure_quality"),
    Channel("wind_speed", "wdsp", "wind_speed_quality"),
    Channel("rainfall", "rain", "rain_quality"),
    Channel("dew_point", "dewpt"),
    Channel("wet_bulb", "wetb", "wetb_quality"),
    Channel("vapour_pressure", "vappr"),
    Channel("wind_direction", "wddir"),
)

#: The source's columns by position.
COLUMNS = (
    "date", "rain_quality", "rain", "temp_quality", "temp", "wetb_quality", "wetb", "dewpt", "vappr", "rhum", "msl",
    "pressure_quality", "wdsp", "wind_speed_quality", "wddir", "ww", "w", "sun", "vis", "clht", "clamt",
)


@dataclass(frozen=True)
class Windows:
    length: int = 24
    stride: int = 1
    horizon: int = 24
    max_lag: int = 6
    tolerance: int = 1
    history: int = 4


@dataclass(frozen=True)
class Regimes:
    history: int = 24
    fit: int = 24
    min_run: int = 3
    min_changed: int = 2
    min_length: int = 6


@dataclass(frozen=True)
class Config:
    channels: tuple[Channel, ...] = CHANNELS
    highest_flag: int = 2
    smooth: int = 5
    upper: float = 0.9
    lower: float = 0.1
    windows: Windows = field(default_factory=Windows)
    regimes: Regimes = field(default_factory=Regimes)
