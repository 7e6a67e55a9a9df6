from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfline.operators.daily import categories, daily_table, date_bounds, filter_days
from shelfline.operators.quality import require_valid, validation_report, verdict
from shelfline.schema import TEXT_SCHEMA
from shelfline.sources.feeds import read_csv, read_sample

NAMES = [f.name for f in TEXT_SCHEMA.fields]
GOOD = {"date": "2024-01-01", "product": "p", "category": "A", "inventory": "100",
        "units_sold": "5", "unit_cost": "5", "selling_price": "10", "supplier": "s",
        "lead_time_days": "7"}


def feed(spark, *changes):
    rows = [{**GOOD, **change} for change in changes]
    df = spark.createDataFrame([tuple(row[n] for n in NAMES) for row in rows], TEXT_SCHEMA)
    return df.coalesce(1).withColumn("seq", F.monotonically_increasing_id())


def report(df):
    return {(r.check, r.column): r for r in validation_report(df).collect()}


def test_missing_column_stops_everything(spark):
    found = validation_report(feed(spark, {"inventory": "-1"}).drop("supplier")).collect()
    assert [r.check for r in found] == ["MISSING_COLUMN"]
    assert "Missing required columns" in found[0].message and "supplier" in found[0].message


def test_clean_input_is_valid(spark):
    rows = feed(spark, {}, {"date": "2024-01-02"})
    assert validation_report(rows).count() == 0
    assert verdict(validation_report(rows)).first().is_valid
    assert require_valid(rows) is rows


@pytest.mark.parametrize("change,check,column,text", [
    ({"date": "not-a-date"}, "INVALID_DATE", "date", "Invalid date values found: 1 row(s)"),
    ({"inventory": "not-a-number"}, "NOT_NUMERIC", "inventory",
     "Column 'inventory' must be numeric"),
    ({"lead_time_days": "0"}, "LEAD_TIME", "lead_time_days",
     "Column 'lead_time_days' must be positive"),
    ({"lead_time_days": "-3"}, "LEAD_TIME", "lead_time_days",
     "Column 'lead_time_days' must be positive"),
    ({"inventory": "-10"}, "NEGATIVE", "inventory", "Column 'inventory' contains negative values"),
    ({"product": None}, "MISSING", "product", "Column 'product' contains missing values"),
])
def test_errors(spark, change, check, column, text):
    rows = feed(spark, {}, {"date": "2024-01-02", **change})
    found = report(rows)
    assert found[check, column].message == text
    assert not verdict(validation_report(rows)).first().is_valid
    with pytest.raises(ValueError, match="|".join([text.split("(")[0]])):
        require_valid(rows)


def test_warnings_do_not_invalidate(spark):
    rows = feed(spark, {}, {}, {"date": "2024-01-02", "inventory": None})
    found = report(rows)
    assert found["DUPLICATE", "product,date"].n_rows == 2
    assert found["MISSING_INVENTORY", "inventory"].n_rows == 1
    assert verdict(validation_report(rows)).first().asDict() == {
        "is_valid": True, "n_errors": 0, "n_warnings": 2}


def test_type_errors_suppress_value_checks(spark):
    found = report(feed(spark, {"inventory": "x"}, {"unit_cost": "-1", "product": None}))
    assert set(found) == {("NOT_NUMERIC", "inventory")}


def test_null_date_is_no_error_but_row_is_dropped(spark):
    rows = feed(spark, {}, {"date": None})
    assert validation_report(rows).count() == 0
    assert daily_table(rows).count() == 1


def test_daily_derivations(spark):
    rows = feed(
        spark,
        {"product": "a", "date": "2024-01-02", "inventory": "150"},
        {"product": "a"},
        {"product": "free", "units_sold": "10", "selling_price": "0"},
        {"product": "thin", "units_sold": "10", "unit_cost": "8"},
    )
    found = {(r.product, str(r.date)): r for r in daily_table(rows).collect()}
    first, second = found["a", "2024-01-01"], found["a", "2024-01-02"]
    assert first.inventory_change is None and first.opening_inventory is None
    assert (second.opening_inventory, second.inventory_change, second.sales_velocity) == (100, 50, 5)
    free, thin = found["free", "2024-01-01"], found["thin", "2024-01-01"]
    assert (free.daily_revenue, free.daily_profit, free.profit_margin) == (0, -50, 0)
    assert (thin.daily_revenue, thin.daily_profit) == (100, 20)
    assert thin.profit_margin == pytest.approx(0.2)
    assert thin.inventory_value == 800


@pytest.mark.parametrize("one_per_day", [False, True])
def test_same_day_rows_sum_units_and_keep_last_known_values(spark, one_per_day):
    rows = feed(
        spark,
        {"inventory": "100", "category": "old", "supplier": "s1"},
        {"inventory": "90", "category": "new", "supplier": None},
        {"inventory": None, "category": None, "supplier": "s2", "unit_cost": "6"},
        {"product": "none", "units_sold": None, "inventory": None},
    )
    found = {r.product: r for r in daily_table(rows, one_record_per_day=one_per_day).collect()}
    row = found["p"]
    assert (row.units_sold, row.inventory, row.category, row.supplier, row.unit_cost) == (
        15, 90, "new", "s2", 6)
    assert found["none"].units_sold == 0 and found["none"].inventory is None


def test_nan_counts_as_missing(spark):
    rows = feed(spark, {"inventory": "NaN"})
    assert daily_table(rows).first().inventory is None
    typed = rows.withColumn("inventory", F.col("inventory").cast("double"))
    assert report(typed)["MISSING_INVENTORY", "inventory"].n_rows == 1


def test_filters(spark):
    daily = daily_table(feed(
        spark,
        {"product": "Widget A", "category": "X"},
        {"product": "Widget A", "category": "X", "date": "2024-01-02", "inventory": "120"},
        {"product": "gadget (b)", "category": "Y", "date": "2024-01-03"},
        {"product": "gizmo", "category": None, "date": "2024-01-03"},
    ))
    assert filter_days(daily).count() == 4
    later = filter_days(daily, "2024-01-02", "2024-01-02").collect()
    assert [(r.product, r.opening_inventory) for r in later] == [("Widget A", 100.0)]
    assert {r.product for r in filter_days(daily, categories=["Y"]).collect()} == {"gadget (b)"}
    assert filter_days(daily, search="WIDGET").count() == 2
    assert filter_days(daily, search="^g.*o$").count() == 1
    assert filter_days(daily, search="(b)", literal=True).count() == 1
    assert [r.category for r in categories(daily).collect()] == ["X", "Y"]
    assert [r.category for r in categories(daily, "Uncategorized").collect()] == [
        "Uncategorized", "X", "Y"]
    assert tuple(map(str, date_bounds(daily).first())) == ("2024-01-01", "2024-01-03")
    empty = date_bounds(daily.where("false")).first()
    assert (empty.max_date - empty.min_date).days == 90


def test_csv(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text(
        "id,date,product,category,inventory,units_sold,unit_cost,selling_price,supplier,"
        "lead_time_days,note\n"
        "7,2024-01-01,p,A,10,1,5,10,s,7,x\n"
        "3,2024-01-01,p,B,NA,2,5,10,s,7,y\n"
        "4,2024-01-02 08:30:00,p,n/a,,3,5,10,s,7,\n")
    raw = read_csv(spark, str(path))
    assert "note" in raw.columns
    assert report(raw)["MISSING_INVENTORY", "inventory"].n_rows == 2
    rows = daily_table(raw).orderBy("date").collect()
    assert [(r.units_sold, r.inventory, r.category) for r in rows] == [(3, 10, "B"), (3, None, None)]
    assert "note" not in rows[0].asDict()


def test_csv_date_format_and_many_files(spark, tmp_path):
    header = ",".join(NAMES) + "\n"
    (tmp_path / "part-1.csv").write_text(header + "31/01/2024,p,A,1,1,5,10,s,7\n")
    (tmp_path / "part-2.csv").write_text(header + "31/01/2024,p,A,2,1,5,10,s,7\n")
    rows = daily_table(read_csv(spark, str(tmp_path), date_format="dd/MM/yyyy")).collect()
    assert [(str(r.date), r.inventory, r.units_sold) for r in rows] == [("2024-01-31", 2, 2)]


def test_missing_sample_is_an_empty_feed(spark, tmp_path):
    assert daily_table(read_sample(spark, str(tmp_path / "absent.csv"))).count() == 0


def test_only_whole_dates_and_numbers_are_read(spark):
    from shelfline.schema import day, number

    rows = [("2024-01-05",), ("2024-01-05 10:00:00",), ("2024-01-05 xyz",), ("2024-01",), ("2024-02-30",), ("5d",), ("7f",),
            ("0x1p3",), ("5",), (" -1.5e2 ",), ("inf",), (".5",), ("",)]
    df = spark.createDataFrame(rows, "value string")
    found = [(r.value, str(r.d) if r.d else None, r.n) for r in df.select("value", day("value").alias("d"),
                                                                          number("value").alias("n")).collect()]
    assert [d for _, d, _ in found] == ["2024-01-05", "2024-01-05", *[None] * 11]
    assert [n for _, _, n in found] == [None] * 8 + [5.0, -150.0, float("inf"), 0.5, None]


def test_csv_quotes_and_field_counts(spark, tmp_path):
    import pytest

    from shelfline.sources.feeds import read_csv

    path = tmp_path / "feed.csv"
    path.write_text('product,category,units_sold\n"Mug ""L"", blue",a,1\nshort,b\n"two\nlines",c,3\n')
    rows = [tuple(r)[:3] for r in read_csv(spark, str(path), multi_line=True).collect()]
    assert rows == [('Mug "L", blue', "a", "1"), ("short", "b", None), ("two\nlines", "c", "3")]
    path.write_text("product,category,units_sold\na,b,1,surplus\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(path)).collect()


def test_text_does_not_order_and_missing_numbers_come_first(spark):
    from shelfline.operators import daily

    base = ("2024-01-01", "p", "c", "s", 1.0, 2.0, 3.0, 4.0)
    columns = ("date string, product string, category string, supplier string, units_sold double, unit_cost double, "
               "selling_price double, lead_time_days double, inventory double, ")
    for kind, ids, last in (("string", ["9", "10"], 20.0), ("bigint", [10, 9], 10.0), ("bigint", [None, 9], 20.0),
                            ("bigint", [None, None], None)):
        rows = [(*base, inventory, n) for inventory, n in zip((10.0, 20.0), ids)]
        found = daily.daily_table(spark.createDataFrame(rows, columns + f"id {kind}").coalesce(1)).first()
        assert found.category == "c" and found.inventory is not None
        assert last is None or found.inventory == last
