"""Product risk: six 0-100 components, weighted over those that are available."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfline.functions.guards import UNKNOWN, at_most_100, band, ended, number, quoted, ratio, staged
from shelfline.params import DEFAULTS, Params

COMPONENTS = ["stockout_exposure", "demand_volatility", "demand_trend", "excess_inventory",
              "financial_exposure", "seasonality"]


@dataclass(frozen=True)
class Signals:
    """Demand-side inputs of the score: column names, or literals in what-if runs."""

    cv: str = "cv"
    trend: str = "trend"
    strength: str = "trend_strength"
    seasonal_deviation: str = "seasonal_deviation"
    financial_reference: str = UNKNOWN


def trend_component(signals: Signals, stock: str, reorder: str, target: str,
                    params: Params = DEFAULTS) -> str:
    """Trend pressure in the light of current stock; a stable trend scores a constant."""
    short, over = f"{stock} < {reorder}", f"{stock} > {target}"
    weight = (f"case {signals.trend} "
              f"when 'INCREASING' then case when {short} then 1D when {over} then 0.5D else 0.7D end "
              f"when 'DECREASING' then case when {over} then 1D when {short} then 0.5D else 0.7D end "
              f"end")
    known = f"{stock} is not null and {reorder} is not null and {target} is not null"
    return (f"case when {signals.strength} is null then null "
            f"when {signals.trend} = 'STABLE' then {number(params.stable_trend_score)} "
            f"when {known} then {at_most_100(f'abs({signals.strength}) * 100')} * {weight} end")


def excess_component(stock: str, target: str, excess: str) -> str:
    known = f"{stock} is not null and {target} is not null"
    return (f"case when {known} and {excess} <= 0 then 0D "
            f"when {known} and {target} > 0 then {at_most_100(f'{excess} / {target} * 100')} end")


def risk_level(score: str, params: Params = DEFAULTS) -> str:
    return band(score, params.low_risk_max, params.medium_risk_max, ("LOW", "MEDIUM", "HIGH"))


def with_risk(df: DataFrame, signals: Signals = Signals(), inventory: str = "current_inventory",
              params: Params = DEFAULTS, prefix: str = "") -> DataFrame:
    """Add component scores, weights, score and level.  Needs planning and financial columns."""
    return with_risk_level(with_scores(df, signals, inventory, params, prefix), params, prefix)


def with_risk_level(df: DataFrame, params: Params = DEFAULTS, prefix: str = "") -> DataFrame:
    return staged(df, {f"{prefix}risk_level": risk_level(f"{prefix}risk_score", params)})


def with_scores(df: DataFrame, signals: Signals = Signals(), inventory: str = "current_inventory",
                params: Params = DEFAULTS, prefix: str = "") -> DataFrame:
    """The numeric part of `with_risk`."""
    p = prefix
    reference = signals.financial_reference
    total = f"{p}available_weight_sum"
    weights = {f"{p}{name}_score": number(params.risk_weights[name]) for name in COMPONENTS}
    available = " + ".join(f"if({score} is null, 0D, {w})" for score, w in weights.items())
    share = " + ".join(f"coalesce({score} * ({w} / {total}), 0D)" for score, w in weights.items())
    return staged(
        df,
        {
            f"{p}stockout_exposure_score": at_most_100(f"{p}stockout_probability * 100"),
            f"{p}demand_volatility_score": at_most_100(f"{signals.cv} * 50"),
            f"{p}demand_trend_score": trend_component(
                signals, inventory, f"{p}reorder_point", f"{p}target_stock", params),
            f"{p}excess_inventory_score": excess_component(
                inventory, f"{p}target_stock", f"{p}excess_units"),
            f"{p}financial_exposure_score": at_most_100(
                f"({ratio(f'{p}revenue_at_risk', reference)}) * 100"),
            f"{p}seasonality_score": at_most_100(f"{signals.seasonal_deviation} * 100"),
        },
        {total: ended(available)},
        {f"{p}risk_score": f"case when {total} > 0 then least(greatest({share}, 0D), 100D) end"},
    )


def weights_used(params: Params = DEFAULTS, prefix: str = "") -> str:
    """map<string,double> of the weights of the available components."""
    none = "cast(array() as array<struct<name:string,weight:double>>)"
    entries = ", ".join(
        f"if({prefix}{name}_score is null, {none}, array(named_struct("
        f"'name', {quoted(name)}, 'weight', {number(params.risk_weights[name])})))"
        for name in COMPONENTS)
    return f"map_from_entries(concat({entries}))"
