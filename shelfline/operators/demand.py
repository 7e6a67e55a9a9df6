"""Demand statistics, trend, outliers and seasonality, all products at once.

`annotate` adds per-product facts to the daily rows with windows; `demand_profile` folds the
annotated rows into one row per product.  Both ask for the same clustering (product) and the same
order (product, date), so together they cost one shuffle and one sort.  A caller that selects a
few columns pays for those only: Catalyst drops unused aggregates and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline import messages
from shelfline.functions.guards import ended, holds, number, quoted, ratio, staged, windowed
from shelfline.params import DEFAULTS, Params

WEEKDAY_COLUMNS = [f"weekday_{k}" for k in range(7)]
MONTH_COLUMNS = [f"month_{k}" for k in range(1, 13)]

DEMAND_COLUMNS = ["observation_count", "mean_demand", "median_demand", "std_dev", "variance", "cv",
                  "min_demand", "max_demand", "zero_demand_days", "volatility"]
TREND_COLUMNS = ["slope", "intercept", "trend_strength", "trend", "trend_significant"]
OUTLIER_COLUMNS = ["q1", "q3", "mad", "outlier_method", "lower_fence", "upper_fence",
                   "outlier_count"]
PATTERN_COLUMNS = ["weeks_observed", "weekdays_observed", "months_observed",
                   "weekday_pattern_available", "monthly_pattern_label", "peak_weekday",
                   "drop_weekday", "peak_month", "drop_month", "seasonal_deviation"]
STATE_COLUMNS = ["category", "current_inventory", "unit_cost", "selling_price", "lead_time_days"]

# One window order for everything, so that all of it shares a sort.
SO_FAR = "(partition by product order by date rows between unbounded preceding and current row)"
WHOLE = ("(partition by product order by date "
         "rows between unbounded preceding and unbounded following)")


def annotate(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Daily rows plus time index, quartiles, MAD, fences and an outlier flag.

    The flag is NULL where detection is unavailable and false for rows without demand.
    """
    factor = number(params.tukey_factor)
    distance = ratio(f"{number(params.mad_scale)} * deviation", "mad")
    rows = windowed(
        daily,
        {
            # The index counts observations: calendar gaps and missing demand do not advance it.
            "t": f"count(units_sold) over {SO_FAR} - 1",
            "observed": f"count(units_sold) over {WHOLE}",
            "quartiles": f"percentile(units_sold, array(0.25D, 0.5D, 0.75D)) over {WHOLE}",
        },
        {"q1": "quartiles[0]", "median": "quartiles[1]", "q3": "quartiles[2]"},
        # Only products on the robust path need the second quantile.
        {"deviation": f"case when q3 = q1 or observed < {params.min_points_for_fences} "
                      f"then abs(units_sold - median) end"},
        {"mad": f"percentile(deviation, 0.5D) over {WHOLE}"},
    )
    return staged(
        rows,
        {"outlier_method": f"case when observed < 2 then null when q3 <> q1 "
                           f"and observed >= {params.min_points_for_fences} then 'IQR' "
                           f"when mad > 0 then 'MAD' end"},
        {
            "lower_fence": f"if(outlier_method = 'IQR', q1 - {factor} * (q3 - q1), null)",
            "upper_fence": f"if(outlier_method = 'IQR', q3 + {factor} * (q3 - q1), null)",
        },
        {"is_outlier":
            f"case outlier_method "
            f"when 'IQR' then {holds('units_sold < lower_fence or units_sold > upper_fence')} "
            f"when 'MAD' then {holds(f'{distance} > {number(params.mad_cut)}')} end"},
    ).drop("quartiles", "deviation")


def _folded(daily: DataFrame, params: Params) -> DataFrame:
    """Annotated rows aggregated per product; the latest row supplies the current state.

    The category of the latest row is a grouping key (it is constant per product) and every other
    aggregate is a number, which keeps this a hash aggregate with generated code.
    """
    rows = windowed(annotate(daily, params), {
        "is_latest": "lead(date) over (partition by product order by date) is null",
        "latest_category": f"last(category) over {WHOLE}",
        "weekday": "weekday(date)",
        "month": "month(date)",
        # Distinct ISO weeks as bits of one long: exact, without a second aggregation.
        "week_bit": "if(units_sold is null, null, shiftleft(1L, weekofyear(date)))",
    })

    def on_latest(name: str) -> str:
        return f"max(if(is_latest, {name}, null))"

    aggregates = {
        "observation_count": "count(units_sold)",
        "mean_demand": "avg(units_sold)",
        "median_demand": "max(median)",
        "variance": "var_samp(units_sold)",
        "min_demand": "min(units_sold)",
        "max_demand": "max(units_sold)",
        "zero_demand_days": "count_if(units_sold = 0)",
        "raw_slope": "regr_slope(units_sold, t)",
        "raw_intercept": "regr_intercept(units_sold, t)",
        "q1": "max(q1)",
        "q3": "max(q3)",
        "mad": "max(mad)",
        "lower_fence": "max(lower_fence)",
        "upper_fence": "max(upper_fence)",
        "flagged": "count_if(is_outlier)",
        "weeks": "bit_count(bit_or(week_bit))",
        "current_inventory": on_latest("inventory"),
        "unit_cost": on_latest("unit_cost"),
        "selling_price": on_latest("selling_price"),
        "lead_time_days": on_latest("lead_time_days"),
        **{f"weekday_mean_{k}": f"avg(if(weekday = {k}, units_sold, null))" for k in range(7)},
        **{f"month_mean_{k}": f"avg(if(month = {k}, units_sold, null))" for k in range(1, 13)},
    }
    return rows.groupBy("product", F.col("latest_category").alias("category")).agg(
        *[F.expr(text).alias(name) for name, text in aggregates.items()])


def _title_of(names: list[str], titles: list[str], extreme: str) -> str:
    """Title of the first bucket that attains the extreme factor."""
    best = f"{extreme}({', '.join(names)})"
    arms = " ".join(f"when {name} then {quoted(title)}" for name, title in zip(names, titles))
    return f"case {best} {arms} end"


def profile_numbers(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The numeric profile with one factor column per weekday and month, and the trend label."""
    buckets = WEEKDAY_COLUMNS + MONTH_COLUMNS
    means = [f"weekday_mean_{k}" for k in range(7)] + [f"month_mean_{k}" for k in range(1, 13)]
    cut = number(params.trend_cut)
    return staged(
        _folded(daily, params),
        {
            "std_dev": "sqrt(variance)",
            "slope": "if(observation_count >= 2, raw_slope, null)",
            "intercept": "if(observation_count >= 2, raw_intercept, null)",
            "weeks_observed": "if(mean_demand <> 0, weeks, 0)",
            **{name: f"case when mean_demand <> 0 then {mean} / mean_demand end"
               for name, mean in zip(buckets, means)},
        },
        {
            "cv": ratio("std_dev", "mean_demand"),
            "trend_strength": "case when mean_demand <> 0 "
                              "then slope * (observation_count - 1) / mean_demand end",
            "seasonal_deviation": f"array_max(transform(array({', '.join(buckets)}), f -> abs(f - 1)))",
        },
        {"trend": f"case when trend_strength > {cut} then 'INCREASING' "
                  f"when trend_strength < -{cut} then 'DECREASING' "
                  f"when trend_strength is not null then 'STABLE' end"},
    ).drop("raw_slope", "raw_intercept", "weeks", *means)


def with_labels(profile: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Names and flags read off the numeric profile."""
    weekdays = " + ".join(f"int({name} is not null)" for name in WEEKDAY_COLUMNS)
    months = " + ".join(f"int({name} is not null)" for name in MONTH_COLUMNS)
    return staged(
        profile,
        {
            "volatility": f"case when observation_count < 2 then null "
                          f"when min_demand = max_demand then 'ZERO_VARIANCE' "
                          f"when cv <= {number(params.low_cv)} then 'LOW' "
                          f"when cv <= {number(params.medium_cv)} then 'MEDIUM' else 'HIGH' end",
            "trend_significant": "trend <> 'STABLE'",
            "outlier_method": "case when observation_count < 2 then null "
                              "when upper_fence is not null then 'IQR' when mad > 0 then 'MAD' end",
            "weekdays_observed": ended(weekdays),
            "months_observed": months,
            "peak_weekday": _title_of(WEEKDAY_COLUMNS, messages.WEEKDAYS, "greatest"),
            "drop_weekday": _title_of(WEEKDAY_COLUMNS, messages.WEEKDAYS, "least"),
            "peak_month": _title_of(MONTH_COLUMNS, messages.MONTHS, "greatest"),
            "drop_month": _title_of(MONTH_COLUMNS, messages.MONTHS, "least"),
        },
        {
            "outlier_count": "if(outlier_method is null, null, flagged)",
            "weekday_pattern_available":
                f"weeks_observed >= {params.min_weeks} and weekdays_observed >= 2",
            "monthly_pattern_label":
                f"case when months_observed >= {params.annual_months} "
                f"then {quoted(messages.ANNUAL_PATTERN)} "
                f"when months_observed >= 2 then {quoted(messages.OBSERVED_PATTERN)} end",
        },
    ).drop("flagged")


def _factor_map(names: list[str], first_key: int) -> str:
    """map<int,double> of the observed factors; NULL when there is none."""
    none = "cast(array() as array<struct<key:int,factor:double>>)"
    entries = ", ".join(
        f"if({name} is null, {none}, array(named_struct('key', {key}, 'factor', {name})))"
        for key, name in enumerate(names, first_key))
    observed = f"coalesce({', '.join(names)}) is not null"
    return f"case when {observed} then map_from_entries(concat({entries})) end"


def demand_profile(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per product: statistics, trend, outliers, seasonality and the latest state.

    Factor maps use 0 = Monday and 1 = January.
    """
    return with_factor_maps(with_labels(profile_numbers(daily, params), params))


def with_factor_maps(profile: DataFrame) -> DataFrame:
    """Two maps in place of the columns per weekday and month."""
    return staged(profile, {
        "weekday_factors": _factor_map(WEEKDAY_COLUMNS, 0),
        "monthly_factors": _factor_map(MONTH_COLUMNS, 1),
    }).drop(*WEEKDAY_COLUMNS, *MONTH_COLUMNS)


def demand_statistics(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return demand_profile(daily, params).select("product", *DEMAND_COLUMNS)


def demand_trend(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return demand_profile(daily, params).select("product", *TREND_COLUMNS)


def outlier_bounds(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return demand_profile(daily, params).select("product", *OUTLIER_COLUMNS)


def outlier_rows(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The flagged rows only; nothing is ever removed from the data."""
    return (annotate(daily, params).where("is_outlier")
            .select("product", "date", "units_sold", "outlier_method"))


def seasonality(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return demand_profile(daily, params).select("product", "mean_demand", *PATTERN_COLUMNS)


def _long_factors(daily: DataFrame, names: list[str], first_key: int, key: str,
                  params: Params) -> DataFrame:
    pairs = ", ".join(f"named_struct('{key}', {k}, 'factor', {name})"
                      for k, name in enumerate(names, first_key))
    return (profile_numbers(daily, params)
            .select("product", F.expr(f"inline(array({pairs}))"))
            .where("factor is not null"))


def weekday_factors(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(product, weekday, factor), Monday = 0."""
    return _long_factors(daily, WEEKDAY_COLUMNS, 0, "weekday", params)


def monthly_factors(daily: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(product, month, factor), years pooled."""
    return _long_factors(daily, MONTH_COLUMNS, 1, "month", params)
