"""Record weights: signal, recency, trust and frequency, multiplied onto a base score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.temporal import quiet_days

# What each signal strength weighs.
SIGNAL_WEIGHTS = {"STANDARD": 1.0, "HIGH": 1.5, "CRITICAL": 2.0}


@dataclass(frozen=True)
class Scoring:
    """Tunables with their defaults."""

    decay: bool = True
    fresh_days: int = 30
    cooling_days: int = 180
    dormant_days: int = 365
    cooling_weight: float = 0.85
    stale_weight: float = 0.7
    dormant_weight: float = 0.5
    unverified_weight: float = 0.5
    frequency: bool = True
    frequency_step: float = 0.1
    frequency_cap: float = 1.5

    def edges(self) -> tuple[int, int, int]:
        """Thresholds in ascending order, whatever was set."""
        cooling = max(self.cooling_days, self.fresh_days)
        return self.fresh_days, cooling, max(self.dormant_days, cooling)


def signal_of(signal: Column) -> Column:
    """The signal strength, STANDARD where it is missing or unknown."""
    return F.when(signal.isin(*SIGNAL_WEIGHTS), signal).otherwise("STANDARD")


def signal_weight(signal: Column) -> Column:
    return F.when(signal == "CRITICAL", 2.0).when(signal == "HIGH", 1.5).otherwise(1.0)


def signal_rank(signal: Column) -> Column:
    return F.when(signal == "CRITICAL", 3).when(signal == "HIGH", 2).otherwise(1)


def strongest(signal: Column) -> Column:
    """Aggregate: the strongest signal of a group, STANDARD where there is none."""
    return F.coalesce(F.max_by(signal_of(signal), signal_rank(signal)), F.lit("STANDARD"))


def age_band(days: Column, config: Scoring = Scoring()) -> Column:
    fresh, cooling, dormant = config.edges()
    return F.when(days < fresh, "FRESH").when(days < cooling, "COOLING").when(days < dormant, "STALE").otherwise("DORMANT")


def recency_weight(last_seen: Column, now: str | Column, config: Scoring = Scoring()) -> Column:
    if not config.decay:
        return F.lit(1.0)
    band = age_band(quiet_days(last_seen, now), config)
    return F.when(band == "FRESH", 1.0).when(band == "COOLING", config.cooling_weight).when(band == "STALE", config.stale_weight).otherwise(config.dormant_weight)


def trust_weight(verification: Column, config: Scoring = Scoring()) -> Column:
    return F.when(verification == "UNVERIFIED", config.unverified_weight).otherwise(1.0)


def frequency_weight(hits: Column, config: Scoring = Scoring()) -> Column:
    """Grows with the number of times a record was used; what is no number counts as none."""
    if not config.frequency:
        return F.lit(1.0)
    n = F.greatest(F.coalesce(hits.try_cast("int"), F.lit(0)), F.lit(0))
    return F.least(1 + config.frequency_step * n, F.lit(config.frequency_cap))


def final_score(base: Column, signal: Column, last_seen: Column, verification: Column, hits: Column, now: str | Column, config: Scoring = Scoring()) -> Column:
    """Base score, never under zero, times all four weights."""
    return F.greatest(base, F.lit(0.0)) * signal_weight(signal) * recency_weight(last_seen, now, config) * trust_weight(verification, config) * frequency_weight(hits, config)
