"""Warnings: what could not be computed for a product, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline import messages as m
from shelfline.functions.guards import filled, quoted, staged, texts
from shelfline.functions.planning import Inputs
from shelfline.params import DEFAULTS, Params

STAGES = ["demand", "trend", "outlier", "pattern", "planning", "financial", "risk"]


def _fixed(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    return [(condition, quoted(text)) for condition, text in pairs]


def planning_notes(inputs: Inputs = Inputs(), prefix: str = "") -> list[tuple[str, str]]:
    """(condition, text expression) over the inputs and results of `with_planning`."""
    lead = f"coalesce({inputs.lead} > 0, false)"
    usable, stocked = f"{lead} and {inputs.sd} is not null", f"{inputs.inventory} is not null"
    return _fixed(
        (f"not {lead}", m.BAD_LEAD_TIME),
        (f"{lead} and {inputs.sd} is null", m.NO_VARIABILITY),
        (f"{usable} and not {stocked}", m.NO_INVENTORY_PLANNING),
        (f"{usable} and {stocked} and not coalesce({inputs.mean} > 0, false)", m.ZERO_MEAN_COVER),
        (f"{usable} and {stocked} and {prefix}lead_time_sd = 0", m.ZERO_VARIABILITY),
    )


def financial_notes(inputs: Inputs = Inputs(), prefix: str = "") -> list[tuple[str, str]]:
    """(condition, text expression) over the inputs and results of `with_financial`; planning follows."""
    own = [(f"{inputs.inventory} is null", m.NO_INVENTORY_FINANCIAL)]
    if inputs.sold is not None:
        own.insert(0, (f"{inputs.sold} > 0 and {prefix}daily_revenue <= 0", m.ZERO_REVENUE))
    return [*_fixed(*own), *planning_notes(inputs, prefix)]


def with_financial_notes(df: DataFrame, inputs: Inputs = Inputs(), prefix: str = "") -> DataFrame:
    """Add the warnings of planning and exposure to rows that have the columns of both."""
    return staged(df, {f"{prefix}planning_warnings": texts(planning_notes(inputs, prefix)),
                       f"{prefix}financial_warnings": texts(financial_notes(inputs, prefix))})


def _stage_notes(params: Params) -> dict[str, list[tuple[str, str]]]:
    """(condition, text expression) per stage over the columns of a product profile.

    A profile plans a product without deviation as certain, so that planning has it.
    """
    stocked = "current_inventory is not null"
    inputs = Inputs(sd="coalesce(std_dev, 0D)")
    directional = "trend in ('INCREASING', 'DECREASING')"
    thresholds = "reorder_point is not null and target_stock is not null"
    patterned = "observation_count > 0 and mean_demand <> 0"

    fixed = _fixed
    return {
        "demand": fixed(
            ("observation_count = 0", m.NO_DEMAND),
            ("observation_count = 1", m.NO_SAMPLE_DEVIATION),
            ("observation_count >= 2 and mean_demand <= 0", m.ZERO_MEAN_CV),
        ),
        "trend": fixed(
            ("observation_count < 2", m.NO_TREND),
            ("observation_count >= 2 and mean_demand = 0", m.ZERO_MEAN_TREND),
        ),
        "outlier": fixed(
            ("observation_count < 2", m.NO_OUTLIERS),
            ("observation_count >= 2 and outlier_method is null", m.ZERO_MAD),
        ),
        "pattern": [
            *fixed(("observation_count = 0", m.NO_SEASONALITY),
                   ("observation_count > 0 and mean_demand = 0", m.ZERO_MEAN_SEASONALITY)),
            (f"{patterned} and not weekday_pattern_available",
             filled(m.FEW_WEEKS, "cast(weeks_observed as string)")),
            (f"{patterned} and months_observed between 2 and {params.annual_months - 1}",
             filled(m.SHORT_HISTORY, "cast(months_observed as string)")),
            *fixed((f"{patterned} and months_observed < 2", m.FEW_MONTHS)),
        ],
        "planning": planning_notes(inputs),
        "financial": financial_notes(inputs),
        "risk": fixed(
            ("stockout_probability is null", m.NO_STOCKOUT_SCORE),
            ("cv is null", m.NO_VOLATILITY_SCORE),
            ("trend is null", m.NO_TREND_SCORE),
            (f"{directional} and not {stocked}", m.TREND_WITHOUT_INVENTORY),
            (f"{directional} and {stocked} and not ({thresholds})", m.TREND_WITHOUT_THRESHOLDS),
            ("excess_units is null", m.NO_EXCESS_SCORE),
            ("excess_units > 0 and target_stock <= 0", m.EXCESS_WITHOUT_TARGET),
            ("revenue_at_risk is null", m.NO_REVENUE_AT_RISK),
            ("revenue_at_risk is not null and financial_exposure_score is null", m.NO_REFERENCE),
            ("seasonal_deviation is null", m.NO_SEASONALITY_SCORE),
            ("risk_score is null", m.NO_COMPONENTS),
        ),
    }


def with_notes(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add one array of warning texts per stage to a product profile.

    The arrays are filtered, not concatenated: that keeps so many texts out of the generated stages.
    """
    def given(notes: list[tuple[str, str]]) -> str:
        listed = ", ".join(f"if({condition}, {text}, null)" for condition, text in notes)
        return f"filter(array({listed}), x -> x is not null)"

    return staged(profile, {f"{stage}_warnings": given(found) for stage, found in _stage_notes(params).items()})


def product_warnings(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Long form: (product, stage, position, warning)."""
    per_stage = ", ".join(f"named_struct('stage', '{stage}', 'warnings', {stage}_warnings)"
                          for stage in STAGES)
    return (
        with_notes(profile, params)
        .select("product", F.expr(f"inline(array({per_stage}))"))
        .select("product", "stage", F.posexplode("warnings").alias("position", "warning"))
    )
