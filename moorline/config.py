"""Engine settings. Defaults are the production ones; registered queries pass coarser steps where test tables are sparse."""

from __future__ import annotations

from dataclasses import dataclass

MISSING = -1  #: a count that was not observed: never zero, never interpolated
INSTALLED, RENTING, RETURNING = 1, 2, 4  #: bits of ``flags``

#: Sorted order of day kinds: their index is part of the trend layout.
DOW_TYPES = ("sat", "sun_holiday", "weekday")


@dataclass(frozen=True)
class Config:
    horizons_min: tuple[int, ...] = (5, 10, 15, 20, 30, 45, 60, 90, 120, 180)
    step_min: int = 5
    staleness_s: int = 600  #: an older observation is stale (strictly more)
    local_offset_h: int = 9
    sample_rate: float = 0.01
    lags_min: tuple[int, ...] = (5, 10, 15, 30, 60)
    deltas_min: tuple[int, ...] = (15, 30, 60)
    roll_min: int = 60
    flow_min: int = 60
    change_cap_min: int = 180
    near_m: int = 300
    far_m: int = 500
    weather_lat: float = 0.05
    weather_lon: float = 0.0625
    weather_leads: int = 8
    slot_min: int = 15
    profile_days: int = 28
    gap_systems: tuple[str, ...] = ()
    dynamic_systems: tuple[str, ...] = ()
    age_systems: tuple[str, ...] = ()  #: those that report how old a count is


DEFAULT = Config()

#: Steps for the driver's event table, where one entity is seen about twice a day.
SPARSE = Config(horizons_min=(360, 720, 1440), step_min=360, staleness_s=86_400, lags_min=(360, 720, 1440), deltas_min=(720, 1440), roll_min=1440, flow_min=1440, change_cap_min=4320, slot_min=360, gap_systems=("a",), dynamic_systems=("b",), age_systems=("b",), sample_rate=0.25)
