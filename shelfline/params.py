"""Thresholds and weights shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist


# The weights here and the thresholds below decide every label, score and action.
def _risk_weights() -> dict[str, float]:
    return {
        "stockout_exposure": 0.30,
        "demand_volatility": 0.20,
        "demand_trend": 0.15,
        "excess_inventory": 0.15,
        "financial_exposure": 0.10,
        "seasonality": 0.10,
    }


@dataclass(frozen=True)
class Params:
    # planning
    service_level: float = 0.95
    planning_horizon: float = 30.0
    # demand labels
    low_cv: float = 0.25
    medium_cv: float = 0.75
    trend_cut: float = 0.10
    # outliers
    tukey_factor: float = 1.5
    mad_scale: float = 0.6745
    mad_cut: float = 3.5
    min_points_for_fences: int = 5
    # seasonality
    min_weeks: int = 4
    annual_months: int = 12
    # risk
    risk_weights: dict[str, float] = field(default_factory=_risk_weights)
    stable_trend_score: float = 20.0
    low_risk_max: float = 39.0
    medium_risk_max: float = 69.0
    # category mix
    category_average_weight: float = 0.70
    category_value_weight: float = 0.15
    category_high_risk_weight: float = 0.15
    # recommendation
    stockout_signal: float = 0.3
    stockout_critical: float = 0.6
    stockout_elevated: float = 0.5
    excess_signal: float = 0.2
    excess_severe: float = 0.5
    volatile_cv: float = 1.0
    material_excess_units: float = 100.0
    # events
    replenishment_factor: float = 1.2
    # reports
    top_k: int = 10

    @property
    def z_score(self) -> float:
        """Normal quantile of the service level; a constant of the plan."""
        return NormalDist().inv_cdf(self.service_level)


DEFAULTS = Params()
