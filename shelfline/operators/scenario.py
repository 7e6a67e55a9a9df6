"""What-if runs: the same formulas under changed demand and lead time, for all products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline import messages
from shelfline.functions.guards import UNKNOWN, quoted, staged
from shelfline.functions.planning import Inputs, with_financial, with_planning
from shelfline.functions.recommend import Context, with_recommendation
from shelfline.functions.risk import Signals, with_risk
from shelfline.operators.profile import with_planning_inputs
from shelfline.params import DEFAULTS, Params

COMPARED = ["lead_time_demand", "safety_stock", "reorder_point", "stockout_probability",
            "reorder_quantity", "days_remaining", "target_stock", "excess_units",
            "excess_inventory_value", "revenue_at_risk", "profit_at_risk", "risk_score"]
LABELS = ["risk_level", "action", "priority"]
BASE, WHAT_IF = "base_", "scenario_"
# A what-if run takes demand as given: 30 observations, no trend, no spread label, no seasons.
ASSUMED_OBSERVATIONS = "30"


@dataclass(frozen=True)
class Grid:
    """Every combination of demand changes (percent) and lead-time changes (days)."""

    demand_percent: Sequence[int] = tuple(range(-50, 101))
    lead_days: Sequence[int] = tuple(range(-5, 15))

    def expand(self, df: DataFrame) -> DataFrame:
        """Every row under every combination; both lists are constants of the plan."""
        def repeated(values: Sequence[int], name: str) -> Column:
            return F.explode(F.array(*[F.lit(int(v)) for v in values])).alias(name)

        pairs = df.select("*", repeated(self.demand_percent, "percent"))
        pairs = pairs.select("*", repeated(self.lead_days, "days"))
        return staged(pairs, {
            "scenario_id": "concat('d', percent, '_l', days)",
            "mean_demand_change_pct": "percent / 100D",
            "lead_time_days_change": "double(days)",
        }).drop("percent", "days")


@dataclass(frozen=True)
class Scenarios:
    """Scenarios given one by one: (id, relative demand change, lead-time change in days)."""

    listed: Sequence[tuple[str, float | None, float | None]]

    def expand(self, df: DataFrame) -> DataFrame:
        return df.select("*", F.inline(F.array(*[F.struct(
            F.lit(name).alias("scenario_id"),
            F.lit(change).cast("double").alias("mean_demand_change_pct"),
            F.lit(days).cast("double").alias("lead_time_days_change"),
        ) for name, change, days in self.listed])))


def _evaluated(df: DataFrame, inputs: Inputs, params: Params, prefix: str) -> DataFrame:
    planned = with_planning(df, inputs, params, prefix)
    # The financial part always plans at the default service level.
    priced = with_financial(planned, inputs, Params(planning_horizon=params.planning_horizon), prefix)
    given = {"cv": UNKNOWN, "trend": "'STABLE'", "strength": "0D"}
    scored = with_risk(priced, Signals(seasonal_deviation=UNKNOWN, **given), inputs.inventory,
                       params, prefix)
    context = Context(mean=inputs.mean, observations=ASSUMED_OBSERVATIONS,
                      inventory=inputs.inventory, lead=inputs.lead, **given)
    return with_recommendation(scored, context, params, prefix)


def scenario_results(profile: DataFrame, scenarios: Grid | Scenarios = Grid(),
                     params: Params = DEFAULTS) -> DataFrame:
    """Baseline, scenario and deltas for every product under every scenario.

    The baseline is worked out once per product; each product row is then expanded by the scenario
    list in place, so no join and no shuffle is involved however many products there are.  A
    scenario that makes no sense for a product keeps its row, with the reason in
    ``scenario_error`` and no scenario values.
    """
    inputs = Inputs("planning_mean", "planning_sd", "current_inventory", "lead_time_days",
                    "planning_cost", "planning_price")
    start = with_planning_inputs(profile).select(
        "product", inputs.mean, inputs.sd, inputs.inventory, inputs.lead, inputs.cost, inputs.price)
    baseline = _evaluated(start, inputs, params, BASE).select(
        *start.columns, *[BASE + name for name in COMPARED + LABELS])
    days = "lead_time_days_change"
    expanded = staged(
        scenarios.expand(baseline),
        {
            "scenario_mean": "planning_mean * (1 + coalesce(mean_demand_change_pct, 0D))",
            "scenario_lead": f"lead_time_days + coalesce({days}, 0D)",
        },
        {"scenario_error":
            f"case when scenario_mean < 0 then {quoted(messages.NEGATIVE_SCENARIO_DEMAND)} "
            f"when {days} is not null and not coalesce(lead_time_days > 0, false) "
            f"then {quoted(messages.NO_BASELINE_LEAD_TIME)} "
            f"when {days} is not null and scenario_lead <= 0 "
            f"then {quoted(messages.SCENARIO_LEAD_TIME)} end"},
    )
    changed = Inputs("scenario_mean", inputs.sd, inputs.inventory, "scenario_lead", inputs.cost,
                     inputs.price)

    def if_valid(text: str) -> str:
        return f"if(scenario_error is null, {text}, null)"

    evaluated = _evaluated(expanded, changed, params, WHAT_IF).withColumnsRenamed({
        "planning_mean": "base_mean_demand", "lead_time_days": "base_lead_time_days",
        "scenario_mean": "scenario_mean_demand", "scenario_lead": "scenario_lead_time_days"})
    numbers = ["mean_demand", "lead_time_days", *COMPARED]
    outcome = {f"{WHAT_IF}{name}": if_valid(f"{WHAT_IF}{name}") for name in numbers + LABELS}
    outcome |= {f"delta_{name}": if_valid(f"{WHAT_IF}{name} - {BASE}{name}") for name in numbers}
    moved = "sign(delta_risk_score)"
    return evaluated.select(
        "product", "scenario_id", "mean_demand_change_pct", days, "scenario_error",
        *[BASE + name for name in numbers + LABELS],
        *[F.expr(text).alias(name) for name, text in outcome.items()],
    ).withColumn("direction", F.expr(
        f"case {moved} when 1 then 'increases' when -1 then 'decreases' when 0 then 'unchanged' end"))
