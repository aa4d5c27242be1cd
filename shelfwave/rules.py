"""Thresholds and small fixed value lists. One frozen dataclass, so a caller can replace any of them."""

from __future__ import annotations

from dataclasses import dataclass, field


def _source_weights() -> dict[str, int]:
    # Weight of one mention by source kind, in tenths (1.5, 1.0, 1.0, 0.6).
    return {"store": 15, "press": 10, "news": 10, "social": 6}


@dataclass(frozen=True)
class Rules:
    # weekly scoring; volumes are summed in integer tenths so that sums do not depend on row order
    source_weights: dict[str, int] = field(default_factory=_source_weights)
    default_weight: int = 10
    baseline_weeks: int = 4
    peak_window: int = 8
    pace_weeks: int = 4
    tone_weeks: int = 4
    sample_weeks: int = 4
    min_sample: int = 50        # tenths: 5.0 weighted mentions over sample_weeks
    min_tone: int = 30          # tenths: 3.0 weighted mentions over tone_weeks
    search_blend: float = 0.3
    search_floor: float = 5.0
    spark_weeks: int = 8
    # shelf
    market_country: str = "TN"
    dimensions: tuple[str, ...] = ("shape", "color", "material", "style")
    product_types: tuple[str, ...] = ("optical", "sun")
    min_tagged: int = 20
    max_unmapped: float = 0.30
    opportunity_share: float = 0.05
    risk_share: float = 0.15
    clearance: float = 0.10
    sun_only: tuple[tuple[str, str], ...] = (("shape", "shield"), ("color", "tinted_lens"))
    pairing_limit: int = 8
    sample_size: int = 5
    new_slots: int = 2
    # catalog history
    new_days: int = 30
    late_factor: int = 2
    min_new_for_shares: int = 10
    new_dimensions: tuple[str, ...] = ("shape", "color", "material")
    top_attributes: int = 6
    min_listed_share: tuple[int, int] = (7, 10)
    cadence_slack_hours: int = 12
    retry_after_hours: int = 20
    # weekly brief
    must_cite_dimension: str = "color"
    must_cite_min: int = 100    # tenths: 10 weighted mentions over 4 weeks


DEFAULT_RULES = Rules()

# Status codes and their French labels.
STATUS_FR = {
    "en_hausse": "En hausse",
    "au_pic": "Au pic",
    "stable": "Stable",
    "en_baisse": "En baisse",
    "faible": "Peu de données",
}
# Store status codes and their French labels.
STORE_STATUS_FR = {
    "ok": "À jour",
    "late": "En retard",
    "incomplete": "Incomplète",
    "failed": "Échec",
    "manual": "Collecte manuelle",
    "never": "Jamais collectée",
}
# The French word for each shelf.
TYPE_FR = {"optical": "optique", "sun": "solaire"}
