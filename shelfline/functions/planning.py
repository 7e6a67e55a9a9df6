"""Replenishment planning and financial exposure, row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfline.functions.guards import at_least_zero, ended, number, ratio, staged
from shelfline.functions.normal import normal_cdf, normal_quantile, working_columns
from shelfline.params import DEFAULTS, Params


@dataclass(frozen=True)
class Inputs:
    """Names of the input columns of the planning and financial formulas."""

    mean: str = "mean_demand"
    sd: str = "std_dev"
    inventory: str = "current_inventory"
    lead: str = "lead_time_days"
    cost: str = "unit_cost"
    price: str = "selling_price"
    sold: str | None = None
    level: str | None = None  # a service level for each row, instead of the one in the parameters


def _z_score(inputs: Inputs, params: Params, prefix: str) -> str:
    """The normal quantile of the service level: a constant of the plan, or a column of `with_planning`."""
    return number(params.z_score) if inputs.level is None else f"{prefix}z_score"


def with_planning(df: DataFrame, inputs: Inputs = Inputs(), params: Params = DEFAULTS,
                  prefix: str = "") -> DataFrame:
    """Lead-time demand, safety stock, reorder point, cover, stockout probability, quantity.

    With ``inputs.level``, also ``z_score``: the normal quantile of each row's service level.
    """
    i, p = inputs, prefix
    if i.level is not None:
        z = _z_score(i, params, p)
        df = staged(df, *normal_quantile(i.level, z)).drop(*working_columns(z))
    usable = f"{i.lead} > 0 and {i.sd} is not null"
    certain = f"{p}lead_time_sd = 0"
    return staged(
        df,
        {
            f"{p}lead_time_demand": f"case when {usable} then {i.mean} * {i.lead} end",
            f"{p}lead_time_sd": f"case when {usable} then {i.sd} * sqrt({i.lead}) end",
            f"{p}days_remaining": f"case when {usable} and {i.mean} > 0 "
                                  f"then {i.inventory} / {i.mean} end",
        },
        {
            f"{p}safety_stock": f"{_z_score(i, params, p)} * {p}lead_time_sd",
            f"{p}standing": ended(ratio(f"{i.inventory} - {p}lead_time_demand", f"{p}lead_time_sd")),
        },
        {
            f"{p}reorder_point": f"{p}lead_time_demand + {p}safety_stock",
            f"{p}stockout_probability":
                f"case when {certain} and {i.inventory} < {p}lead_time_demand then 1D "
                f"when {certain} and {i.inventory} >= {p}lead_time_demand then 0D "
                f"else 1D - {normal_cdf(f'{p}standing')} end",
        },
        {f"{p}reorder_quantity": at_least_zero(f"{p}reorder_point - {i.inventory}")},
    ).drop(f"{p}standing")


def with_financial(df: DataFrame, inputs: Inputs = Inputs(), params: Params = DEFAULTS,
                   prefix: str = "") -> DataFrame:
    """Inventory value, shortage exposure and excess.  Needs the columns of `with_planning`.

    Daily revenue, cost of goods, profit and margin are added when ``inputs.sold`` names a column.
    """
    i, p = inputs, prefix
    exposure = staged(
        df,
        {
            f"{p}profit_per_unit": f"{i.price} - {i.cost}",
            f"{p}inventory_value": f"{i.inventory} * {i.cost}",
            f"{p}capital_tied_up": f"{i.inventory} * {i.cost}",
            f"{p}shortage_units": at_least_zero(f"{p}lead_time_demand - {i.inventory}"),
            f"{p}target_stock": f"{i.mean} * {number(params.planning_horizon)} "
                                f"+ {_z_score(i, params, p)} * {p}lead_time_sd",
        },
        {
            f"{p}revenue_at_risk": f"{p}shortage_units * {i.price}",
            f"{p}profit_at_risk": f"{p}shortage_units * ({i.price} - {i.cost})",
            f"{p}excess_units": at_least_zero(f"{i.inventory} - {p}target_stock"),
        },
        {f"{p}excess_inventory_value": f"{p}excess_units * {i.cost}"},
    )
    if i.sold is None:
        return exposure
    return staged(
        exposure,
        {
            f"{p}daily_revenue": f"{i.sold} * {i.price}",
            f"{p}daily_cogs": f"{i.sold} * {i.cost}",
            f"{p}daily_profit": f"{i.sold} * {i.price} - {i.sold} * {i.cost}",
        },
        {f"{p}gross_margin": margin(f"{p}daily_profit", f"{p}daily_revenue")},
    )


def margin(profit: str, revenue: str) -> str:
    """profit / revenue, 0 without revenue, NULL when revenue is unknown."""
    return (f"case when {revenue} > 0 then {profit} / {revenue} "
            f"when {revenue} is not null then 0D end")
