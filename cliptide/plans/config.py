"""Settings of a highlight run."""

from __future__ import annotations

from dataclasses import dataclass

#: Highlight minutes at the short and the long knee, by profile. Any other name means Moyen.
PROFILES = {"Court": (6, 10), "Moyen": (10, 20), "Longue": (20, 40)}


@dataclass(frozen=True)
class HighlightConfig:
    profile: str = "Moyen"
    chunk_s: int = 10
    min_chunk_s: float = 1.0
    silence_db: float = -40.0
    short_s: float = 7200.0
    long_s: float = 18000.0
    pad_s: float = 0.3
    bins: int = 5
    bin_cap_s: float = 60.0
    vertical: bool = True
