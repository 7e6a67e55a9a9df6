from __future__ import annotations

import math
from datetime import date

import pytest

from shelfline import messages as m
from shelfline.functions.notes import with_notes
from shelfline.operators.demand import (annotate, demand_profile, monthly_factors, outlier_rows,
                                        weekday_factors)
from shelfline.operators.profile import product_profile


@pytest.fixture(scope="module")
def stats(series, by_product):
    return by_product(demand_profile(series({
        "up": [8, 10, 12], "skewed": [3, 5, 8, 20], "medium": [5, 10, 15, 20],
        "high": [1, 10, 1, 10], "flat": [10, 10, 10], "zero": [0, 0, 0], "one": [10],
        "gaps": [10, None, 20, None, 30], "above": [9.4, 10, 10.6], "below": [9.6, 10, 10.4],
        "none": [None, None], "iqr": [1, 2, 3, 4, 100], "mad": [1, 2, 2, 100],
        "same": [5, 5, 5, 5], "tenths": [0.1, 0.1, 0.1],
    })))


def test_statistics(stats):
    up, skewed = stats["up"], stats["skewed"]
    assert (up["mean_demand"], up["median_demand"], up["std_dev"], up["variance"]) == (10, 10, 2, 4)
    assert up["cv"] == pytest.approx(0.2) and up["volatility"] == "LOW"
    assert (up["min_demand"], up["max_demand"], up["observation_count"]) == (8, 12, 3)
    assert (skewed["mean_demand"], skewed["median_demand"]) == (9, 6.5)
    assert skewed["variance"] == pytest.approx(58)
    assert stats["medium"]["volatility"] == "MEDIUM" and stats["high"]["volatility"] == "HIGH"


def test_statistics_edges(stats):
    assert stats["flat"]["cv"] == 0 and stats["flat"]["volatility"] == "ZERO_VARIANCE"
    assert stats["tenths"]["volatility"] == "ZERO_VARIANCE"
    zero, one, none, gaps = (stats[k] for k in ("zero", "one", "none", "gaps"))
    assert zero["cv"] is None and zero["volatility"] == "ZERO_VARIANCE" and zero["trend"] is None
    assert zero["zero_demand_days"] == 3
    assert one["mean_demand"] == 10
    assert one["std_dev"] is one["variance"] is one["cv"] is one["volatility"] is None
    assert none["observation_count"] == 0 and none["mean_demand"] is none["median_demand"] is None
    assert (gaps["observation_count"], gaps["mean_demand"]) == (3, 20)


def test_trend(stats):
    up = stats["up"]
    assert (up["slope"], up["intercept"]) == (pytest.approx(2), pytest.approx(8))
    assert up["trend_strength"] == pytest.approx(0.4)
    assert up["trend"] == "INCREASING" and up["trend_significant"] is True
    assert stats["above"]["trend_strength"] == pytest.approx(0.12)
    assert stats["above"]["trend"] == "INCREASING"
    assert stats["below"]["trend_strength"] == pytest.approx(0.08)
    assert stats["below"]["trend"] == "STABLE" and stats["below"]["trend_significant"] is False
    assert stats["one"]["slope"] is stats["one"]["trend"] is None
    assert stats["zero"]["slope"] == 0 and stats["zero"]["trend_strength"] is None
    # missing days do not advance the time index
    assert stats["gaps"]["slope"] == pytest.approx(10)


def test_outliers(stats, series):
    iqr, mad = stats["iqr"], stats["mad"]
    assert (iqr["outlier_method"], iqr["lower_fence"], iqr["upper_fence"]) == ("IQR", -1, 7)
    assert iqr["outlier_count"] == mad["outlier_count"] == 1
    assert mad["outlier_method"] == "MAD" and mad["lower_fence"] is mad["upper_fence"] is None
    assert stats["same"]["outlier_method"] is stats["same"]["outlier_count"] is None
    assert stats["one"]["outlier_method"] is None
    flagged = outlier_rows(series({"iqr": [1, 2, 3, 4, 100], "mad": [1, 2, 2, 100]}))
    assert {(r.product, r.units_sold) for r in flagged.collect()} == {("iqr", 100), ("mad", 100)}
    flags = [r.is_outlier for r in annotate(series({"g": [1, 2, None, 3, 4, 100]}))
             .orderBy("date").collect()]
    assert flags == [False, False, False, False, False, True]
    assert all(r.is_outlier is None for r in annotate(series({"s": [5, 5, 5]})).collect())


def test_weekday_pattern(series, by_product):
    week = [5, 10, 15, 20, 5, 10, 15]
    daily = series({"four": week * 4, "two": week * 2})
    found = by_product(demand_profile(daily))
    four, two = found["four"], found["two"]
    mean = sum(week) / 7
    assert four["weekday_factors"] == pytest.approx({k: v / mean for k, v in enumerate(week)})
    assert four["weekday_pattern_available"] is True
    assert (four["peak_weekday"], four["drop_weekday"]) == ("Thursday", "Monday")
    assert two["weekday_pattern_available"] is False and two["weeks_observed"] == 2
    long_form = {(r.product, r.weekday): r.factor for r in weekday_factors(daily).collect()}
    assert long_form["four", 3] == pytest.approx(20 / mean) and len(long_form) == 14


def test_monthly_pattern(series, by_product):
    year = [10 if i < 31 else 5 for i in range(365)]
    daily = series({"year": year, "sixty": [1, 2] * 30, "zero": [0] * 40}, start=date(2024, 1, 1))
    found = by_product(demand_profile(daily))
    yearly = found["year"]
    assert yearly["monthly_factors"][1] == pytest.approx(1.843434, abs=1e-6)
    assert yearly["monthly_factors"][2] == pytest.approx(0.921717, abs=1e-6)
    assert yearly["monthly_pattern_label"] == m.ANNUAL_PATTERN
    assert (yearly["peak_month"], yearly["drop_month"]) == ("January", "February")
    assert found["sixty"]["monthly_pattern_label"] == m.OBSERVED_PATTERN
    assert found["zero"]["weekday_factors"] is found["zero"]["monthly_factors"] is None
    assert found["zero"]["weekday_pattern_available"] is False
    assert {r.month for r in monthly_factors(daily).where("product = 'sixty'").collect()} == {1, 2}


def test_weeks_are_pooled_over_years(spark, by_product):
    from daily_rows import DAILY
    rows = [("p", date(year, 1, 10), "A", 1.0, 5.0, 1.0, 2.0, 3.0) for year in range(2018, 2024)]
    weeks = by_product(demand_profile(spark.createDataFrame(rows, DAILY)))["p"]["weeks_observed"]
    assert weeks == len({date(y, 1, 10).isocalendar().week for y in range(2018, 2024)})


def test_latest_state_is_not_carried_forward(spark, by_product):
    from daily_rows import DAILY
    rows = [("p", date(2024, 1, 1), "A", 10.0, 1.0, 1.0, 2.0, 3.0),
            ("p", date(2024, 1, 2), "B", None, 2.0, 1.5, None, 4.0)]
    p = by_product(demand_profile(spark.createDataFrame(rows, DAILY)))["p"]
    assert (p["category"], p["current_inventory"], p["unit_cost"], p["selling_price"],
            p["lead_time_days"]) == ("B", None, 1.5, None, 4.0)


def test_warnings(series, by_product):
    profile = product_profile(series({"zero": [0, 0, 0], "one": [10], "short": [1, 2, 3] * 14}))
    noted = by_product(with_notes(profile))
    zero, one, short = noted["zero"], noted["one"], noted["short"]
    assert zero["demand_warnings"] == [m.ZERO_MEAN_CV]
    assert zero["trend_warnings"] == [m.ZERO_MEAN_TREND]
    assert zero["outlier_warnings"] == [m.ZERO_MAD]
    assert zero["pattern_warnings"] == [m.ZERO_MEAN_SEASONALITY]
    assert zero["planning_warnings"] == [m.ZERO_MEAN_COVER, m.ZERO_VARIABILITY]
    assert one["demand_warnings"] == [m.NO_SAMPLE_DEVIATION] and one["trend_warnings"] == [m.NO_TREND]
    assert one["pattern_warnings"] == [m.FEW_WEEKS.format(1), m.FEW_MONTHS]
    assert short["pattern_warnings"] == [m.SHORT_HISTORY.format(2)]
    assert m.NO_REFERENCE in short["risk_warnings"]


def test_single_observation_is_planned_as_certain(series, by_product):
    p = by_product(product_profile(series({"one": [10]}, inventory=60.0)))["one"]
    assert (p["lead_time_demand"], p["safety_stock"], p["stockout_probability"]) == (70, 0, 1.0)
    assert not math.isnan(p["risk_score"])
