"""The daily table of small fixtures."""

DAILY = ("product string, date date, category string, inventory double, units_sold double, "
         "unit_cost double, selling_price double, lead_time_days double")
