"""Settings of the engine: one immutable record, with every clock an explicit date."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class EngineConfig:
    """as_of: today's date; clock_year: the year from which citations a year are counted."""

    as_of: date = date(2001, 8, 1)
    clock_year: int = 2002
    start_year: int = 1999
    end_year: int = 2001
    top_n: int = 30
    gap_rows: int = 40
    graph_top_n: int = 25
    recent_years: int = 3
    emerging_max_age: int = 3
    early_years: int = 1
    persistent_ratio: float = 0.3
    min_followups: int = 2
    window_days: int = 14
    prior_days: int = 14
    min_recent: int = 2
    hot_top_n: int = 20
    ready_papers: int = 30


DEFAULT = EngineConfig()
