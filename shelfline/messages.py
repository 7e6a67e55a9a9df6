"""Texts that are part of the results.

Fixed values: users and downstream checks read these sentences, so their wording is data.
"{}" marks where a number or name goes.
"""

# --- input validation ------------------------------------------------------------------
MISSING_COLUMNS = "Missing required columns: {}"
INVALID_DATES = "Invalid date values found: {} row(s)"
NOT_NUMERIC = "Column '{}' must be numeric"
NEGATIVE_VALUES = "Column '{}' contains negative values"
LEAD_TIME_NOT_POSITIVE = "Column 'lead_time_days' must be positive"
DUPLICATE_RECORDS = "Ambiguous duplicate product/date records: {} row(s)"
MISSING_INVENTORY = ("Missing inventory values found: {} row(s). "
                     "These remain missing/unavailable and must not be treated as zero.")
MISSING_VALUES = "Column '{}' contains missing values"

# --- demand, trend, outliers, seasonality ----------------------------------------------
NO_DEMAND = "No valid demand observations available."
NO_SAMPLE_DEVIATION = "Insufficient observations for sample standard deviation."
ZERO_MEAN_CV = "Average demand is zero; coefficient of variation is unavailable."
NO_TREND = "Insufficient observations for trend analysis."
ZERO_MEAN_TREND = "Mean demand is zero; trend strength is unavailable."
NO_OUTLIERS = "No valid observations for outlier detection."
ZERO_MAD = "Zero median absolute deviation; outlier detection unavailable."
NO_SEASONALITY = "No valid demand observations for seasonality analysis."
ZERO_MEAN_SEASONALITY = "Overall mean demand is zero; seasonality factors unavailable."
FEW_WEEKS = "Insufficient history for reliable weekday pattern ({} weeks observed)."
SHORT_HISTORY = ("Short history ({} months); treating as observed monthly pattern, "
                 "not annual seasonality.")
FEW_MONTHS = "Insufficient months for monthly pattern analysis."
ANNUAL_PATTERN = "Annual monthly seasonality"
OBSERVED_PATTERN = "Observed monthly pattern"

# --- planning and financial ------------------------------------------------------------
BAD_LEAD_TIME = "Invalid or unavailable lead time; replenishment calculations unavailable."
NO_VARIABILITY = ("Insufficient observations for demand variability; "
                  "replenishment calculations unavailable.")
NO_INVENTORY_PLANNING = ("Missing current inventory; days remaining and reorder quantity "
                         "unavailable.")
ZERO_MEAN_COVER = "Zero mean demand; days remaining unavailable."
ZERO_VARIABILITY = "Zero demand variability; deterministic stockout logic used."
ZERO_REVENUE = "Zero revenue; gross margin set to 0."
NO_INVENTORY_FINANCIAL = ("Missing current inventory; inventory value, capital tied up, "
                          "and excess metrics unavailable.")

# --- risk ------------------------------------------------------------------------------
NO_STOCKOUT_SCORE = "Stockout probability unavailable; stockout component excluded."
NO_VOLATILITY_SCORE = "Coefficient of variation unavailable; volatility component excluded."
NO_TREND_SCORE = "Trend unavailable; trend component excluded."
TREND_WITHOUT_INVENTORY = ("Current inventory unavailable; trend context unknown; "
                           "trend component excluded.")
TREND_WITHOUT_THRESHOLDS = "Inventory thresholds unavailable; trend component excluded."
NO_EXCESS_SCORE = "Excess inventory data unavailable; excess component excluded."
EXCESS_WITHOUT_TARGET = "Target stock is zero or negative; excess component excluded."
NO_REVENUE_AT_RISK = "Revenue at risk unavailable; financial component excluded."
NO_REFERENCE = "Product-set financial reference unavailable; financial component excluded."
NO_SEASONALITY_SCORE = "Seasonality patterns unavailable; seasonality component excluded."
NO_COMPONENTS = "No risk components available; risk score unavailable."
NO_CATEGORY_SCORES = "No valid product risk scores available for category '{}'."
NO_DATA_FOR_HEALTH = "No category or product data available for overall health."

# --- recommendation: data-quality gate -------------------------------------------------
GATE_NO_DEMAND = "No demand observations available"
GATE_NO_LEAD_DEMAND = "Lead-time demand unavailable"
GATE_NO_TARGET = "Target stock unavailable"
GATE_NO_SCORE = "Product risk score unavailable"
GATE_NO_INVENTORY = "Current inventory unavailable"

# --- recommendation: reasons by code ---------------------------------------------------
REASONS = {
    "DATA_INCOMPLETE": "Insufficient verified data for a confident recommendation; "
                       "analysis signals are incomplete.",
    "CONFLICT_STOCKOUT": "Critical stockout probability overrides excess concern; "
                         "stockout is the more immediate threat.",
    "CONFLICT_EXCESS": "Excess inventory is severe despite elevated stockout probability; "
                       "excess takes precedence.",
    "CONFLICT_MONITOR": "Conflicting stockout and excess signals detected; "
                        "monitor for demand pattern clarification.",
    "COVERAGE_BELOW_LEAD": "Inventory coverage ({} days) is below lead time ({} days).",
    "STOCKOUT_ELEVATED": "Stockout probability is elevated at {}.",
    "STOCKOUT_PRESENT": "Stockout risk is present but not yet critical.",
    "DEMAND_INCREASING": "Demand is increasing; monitor closely to maintain adequate "
                         "stock levels.",
    "VOLATILE_COVERED": "Demand is highly volatile but current coverage is adequate; "
                        "monitor for sudden changes.",
    "ZERO_DEMAND_EXCESS": "Mean demand is zero with positive excess inventory; "
                          "no demand justifies holding excess stock.",
    "ZERO_DEMAND": "Mean demand is zero; no stock movement justifies reordering.",
    "EXCESS_SIGNIFICANT": "Excess inventory is significant at {} above target stock.",
    "EXCESS_PRESENT": "Excess inventory is present but not yet critical.",
    "INCREASING_LOW_COVER": "Demand is increasing and coverage is below lead time; "
                            "reorder to keep pace.",
    "DECREASING_HIGH_COVER": "Demand is decreasing and coverage is well above lead time; "
                             "no reorder needed.",
    "RISK_HIGH": "Product risk score is HIGH; review signals before taking action.",
    "RISK_MEDIUM": "Product risk score is MEDIUM; watch for changes.",
    "LOW_COVER_BUFFER": "Coverage is very low despite low risk score; "
                        "reorder to maintain buffer.",
    "HEALTHY": "All verified signals are within healthy ranges.",
    "REORDER_QTY": "Recommended reorder quantity: {} units.",
    "REORDER_QTY_UNKNOWN": "Reorder quantity cannot be determined with current data.",
    "STOCKOUT_ESTIMATE": "Estimated stockout probability during lead time: {} "
                         "(model estimate).",
    "REVENUE_AT_RISK": "Revenue at risk from shortage exposure: {}.",
    "PROFIT_AT_RISK": "Profit at risk from shortage exposure: {}.",
    "EXCESS_VALUE": "Excess inventory value: {}.",
    "CATEGORY_HIGH": "Category risk is HIGH ({}); review category-level signals.",
    "OVERALL_CRITICAL": "Overall inventory health is CRITICAL; prioritize interventions.",
}

# --- what-if input errors --------------------------------------------------------------
NEGATIVE_SCENARIO_DEMAND = "mean_demand_change_pct produces negative mean demand."
NO_BASELINE_LEAD_TIME = "Baseline lead_time_days must be positive to apply a lead-time change."
SCENARIO_LEAD_TIME = "lead_time_days_change produces non-positive lead time."

# --- calendar names --------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
