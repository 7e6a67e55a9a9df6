"""The shape of the physical plans: what is shuffled, joined and kept out."""

from __future__ import annotations

import pytest

from shelfline.operators import daily as days
from shelfline.operators import demand, history, profile, quality, reports, rollup, scenario
from shelfline.plans import catalog
from shelfline.sources.star import daily_feed

FOLDER = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def feed(spark):
    return daily_feed(spark, FOLDER)


def test_profile_is_two_shuffles_and_two_sorts_at_most(feed):
    plan = physical(profile.product_profile(days.daily_table(feed, supplier=False)))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("Exchange hashpartitioning(product#") == 2
    assert "Exchange SinglePartition" not in plan


def test_daily_feeds_need_one_shuffle(feed):
    plan = physical(profile.product_profile(
        days.daily_table(feed, supplier=False, one_record_per_day=True)))
    assert plan.count("Exchange hashpartitioning") == 1


def test_days_are_finished_before_they_are_clustered(feed):
    plan = physical(days.daily_table(feed))
    clustered, below = plan.split("REPARTITION", 1)
    assert "max_by" not in clustered and "Exchange hashpartitioning(product#" in clustered
    assert below.index(" max_by(") < below.index("Exchange hashpartitioning(product#") < below.index("partial_max_by(")


def records(spark, suppliers: int, number_of_days: int):
    """One product, every supplier on every day."""
    return spark.range(suppliers * number_of_days).selectExpr(
        f"date_add(date '2024-01-01', cast(id % {number_of_days} as int)) as date", "'HOT' as product", "'A' as category",
        "double(id) as inventory", "1D as units_sold", "5D as unit_cost", "10D as selling_price",
        f"concat('s', id div {number_of_days}) as supplier", "7D as lead_time_days", "id as seq").repartition(8)


@pytest.mark.parametrize("one_record_per_day, most", [(False, 365), (True, 365_000)])
def test_rows_of_one_product_in_the_clustering_task(spark, one_record_per_day, most):
    """1,000 suppliers on 365 days: finished days alone meet in one task, unless the layout hint says otherwise."""
    table = days.daily_table(records(spark, 1000, 365), one_record_per_day=one_record_per_day)
    assert table.agg({"units_sold": "sum"}).first()[0] == 365_000
    frame = table.drop("opening_inventory", "inventory_change")
    frame.collect()
    assert sorted(rows_read(frame))[-1 if one_record_per_day else 0] == most


def rows_read(frame) -> list[int]:
    """The rows that each exchange of the executed plan has written."""
    plan, found = frame._jdf.queryExecution().executedPlan(), []
    stack = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        stack += [children.apply(n) for n in range(children.size())]
    return found


def test_validation_reads_its_input_once(feed):
    plan = physical(quality.validation_report(feed))
    assert plan.count("FileScan parquet") == 3  # lineitem, part and supplier
    assert plan.count("l_orderkey") and sum("lineitem" in line for line in plan.splitlines()) <= 1


@pytest.mark.parametrize("operator", [
    profile.product_profile, demand.demand_profile, history.inventory_events,
    lambda d: rollup.category_risk(profile.product_profile(d)),
    lambda d: scenario.scenario_results(profile.product_profile(d)),
    lambda d: reports.top_priorities(profile.product_profile(d))])
def test_no_python_and_no_cross_join(feed, operator):
    plan = physical(operator(days.daily_table(feed, supplier=False)))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval",
                     "collect_list"):
        assert unwanted not in plan


def test_scenarios_add_no_shuffle(feed):
    plan = physical(scenario.scenario_results(
        profile.product_profile(days.daily_table(feed, supplier=False))))
    assert plan.count("Exchange hashpartitioning") == 2


def test_product_filter_reaches_the_scan_side(feed):
    table = profile.product_profile(days.daily_table(feed, supplier=False))
    plan = physical(profile.product_detail(table, "P000007"))
    scan = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "P000007" in scan


def test_filter_on_a_derived_column_stays_small(feed):
    table = profile.product_profile(days.daily_table(feed, supplier=False))
    text = table.where("action = 'REORDER' and risk_level = 'HIGH'")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert len(text) < 80_000


def test_unused_columns_are_pruned(feed):
    plan = physical(demand.demand_trend(days.daily_table(feed, supplier=False)))
    assert "percentile" not in plan and "p_retailprice" not in plan.split("FileScan")[1][:200]


def test_top_k_needs_no_full_sort(feed):
    assert "TakeOrderedAndProject" in physical(
        reports.top_risk(profile.product_profile(days.daily_table(feed, supplier=False))))


def test_hot_product_gives_the_same_rows(spark, feed):
    """A third of all records in one product and day: the roll-up equals a plain aggregate."""
    hot = feed.selectExpr("date '1995-05-05' as date", "'HOT' as product", "category", "inventory",
                          "units_sold", "unit_cost", "selling_price", "supplier",
                          "lead_time_days", "seq * 1000000 + cast(units_sold as bigint) as seq")
    mixed = feed.unionByName(hot.sample(0.5, seed=1))
    found = days.daily_table(mixed).where("product = 'HOT'").first()
    total = mixed.where("product = 'HOT'").selectExpr("sum(units_sold) s").first().s
    assert found.units_sold == pytest.approx(total)


def test_catalog_and_oracle_agree_on_names():
    from verification import oracle
    names, statements = set(catalog.queries()), set(oracle.statements())
    assert statements == names


def method_sizes(spark, df) -> list[int]:
    """Bytecodes of the largest method of each stage of generated code; -1 where compilation fails."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [stages.apply(n)._3().maxMethodCodeSize() for n in range(stages.size())]


@pytest.mark.parametrize("name", [
    "reorder_report", "recommendations", "recommendation_reasons", "recommendation_reason_texts", "seasonality_summary",
    "scenario_results", "scenario_deltas", "enriched_reasons", "category_risk", "top_priorities"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = method_sizes(spark, catalog.queries()[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and 0 < min(sizes) and max(sizes) <= 8000, sizes
