"""One DuckDB statement per catalog query, over the plain parquet tables.

Written from the formulas, not from the Spark code: other functions (filtered aggregates, joins,
quantile_cont, list functions), and nested conditions where Spark uses a rule table.
"""

from __future__ import annotations

from statistics import NormalDist

from shelfline import messages as m

Z = f"{NormalDist().inv_cdf(0.95)!r}e0"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _phi(x: str) -> str:
    """Normal distribution function: Hart's approximation in West's form."""
    num = ["3.52624965998911e-02", "0.700383064443688e0", "6.37396220353165e0",
           "33.912866078383e0", "112.079291497871e0", "221.213596169931e0", "220.206867912376e0"]
    den = ["8.83883476483184e-02", "1.75566716318264e0", "16.064177579207e0",
           "86.7807322029461e0", "296.564248779674e0", "637.333633378831e0",
           "793.826512519948e0", "440.413735824752e0"]
    a = f"abs({x})"

    def horner(terms: list[str]) -> str:
        text = terms[0]
        for term in terms[1:]:
            text = f"({text}*{a}+{term})"
        return text

    upper = (f"(case when {a} < 7.07106781186547e0 then exp(-{x}*{x}/2e0)*{horner(num)}/{horner(den)} "
             f"when {a} <= 37e0 then exp(-{x}*{x}/2e0)/(({a}+1e0/({a}+2e0/({a}+3e0/({a}+4e0/({a}+0.65e0)))))"
             f"*2.506628274631e0) else 0e0 end)")
    return f"(case when {x} > 0 then 1e0-{upper} else {upper} end)"


def _levels(levels: list[float]) -> str:
    """Service levels with the z whose upper tail is 1 - level, by bisection; none unless below 1."""
    listed = ", ".join(f"{x!r}e0" for x in levels)
    return f"""tails as (select unnest([{listed}]) as service_level),
bisected as (
  select service_level, 0e0 as low, 40e0 as high, 0 as step from tails where service_level < 1
  union all
  select service_level, case when {_phi('minus')} > 1 - service_level then -minus else low end,
         case when {_phi('minus')} > 1 - service_level then high else -minus end, step + 1
  from (select *, -(low + high) / 2 as minus from bisected) where step < 70),
levels as (
  select t.service_level, (low + high) / 2 as z
  from tails t left join bisected b on t.service_level = b.service_level and step = 70)"""


FEED = """feed as (
  select cast(l.l_shipdate as date) as date,
         concat('P', lpad(cast(p.p_partkey as varchar), 6, '0')) as product,
         p.p_type as category,
         case when l.l_orderkey % 23 = 0 then null
              else cast((l.l_partkey * 7919 + l.l_orderkey * 31 + l.l_linenumber * 17) % 1600
                        as double) end as inventory,
         cast(case when p.p_partkey % 50 = 0 then 0
              when p.p_partkey % 11 = 0
                then case when l.l_orderkey % 10 = 0 then l.l_quantity * 10 else 0 end
              when p.p_partkey % 7 = 1 then l.l_quantity * (year(l.l_shipdate) - 1994)
              when p.p_partkey % 7 = 2 then l.l_quantity * (2002 - year(l.l_shipdate))
              when p.p_partkey % 13 = 3 then 10
              else l.l_quantity end as double) as units_sold,
         p.p_retailprice * cast(0.5 as double) as unit_cost,
         p.p_retailprice as selling_price,
         s.s_name as supplier,
         cast(case when p.p_partkey % 17 = 5 then 60 when p.p_partkey % 17 = 9 then 45
              else 1 + p.p_partkey % 14 end as double) as lead_time_days,
         l.l_orderkey * 10 + l.l_linenumber as seq
  from lineitem l
  join part p on l.l_partkey = p.p_partkey
  join supplier s on l.l_suppkey = s.s_suppkey)"""


def _last(name: str) -> str:
    return f"arg_max({name}, seq) filter (where {name} is not null) as {name}"


DAILY = f"""days as (
  select product, date, coalesce(sum(units_sold), 0) as units_sold,
         {', '.join(_last(c) for c in ['category', 'inventory', 'unit_cost', 'selling_price',
                                       'supplier', 'lead_time_days'])}
  from feed where product is not null and date is not null group by product, date),
daily as (
  select *, units_sold * selling_price as daily_revenue,
         units_sold * (selling_price - unit_cost) as daily_profit,
         inventory * unit_cost as inventory_value,
         lag(inventory) over (partition by product order by date) as opening_inventory
  from days)"""

STATS = """base as (
  select product, count(*) as n, avg(units_sold) as mean, median(units_sold) as med,
         stddev_samp(units_sold) as sd, var_samp(units_sold) as variance, min(units_sold) as lo,
         max(units_sold) as hi, count(*) filter (where units_sold = 0) as zero_days,
         quantile_cont(units_sold, 0.25) as q1, quantile_cont(units_sold, 0.75) as q3
  from daily group by product),
line as (
  select product,
         case when count(*) >= 2 then regr_slope(units_sold, t) end as slope,
         case when count(*) >= 2 then regr_intercept(units_sold, t) end as intercept
  from (select product, units_sold,
               cast(row_number() over (partition by product order by date) - 1 as double) as t
        from daily) group by product),
spread as (
  select d.product, quantile_cont(abs(units_sold - med), 0.5) as mad
  from daily d join base b on d.product = b.product
  where b.q3 - b.q1 = 0 or b.n < 5 group by d.product),
latest as (
  select product, category, inventory, unit_cost, selling_price, lead_time_days from daily
  qualify row_number() over (partition by product order by date desc) = 1),
labelled as (
  select b.*, l.slope, l.intercept, s.mad,
         case when mean > 0 then sd / mean end as cv,
         case when mean <> 0 then slope * (n - 1) / mean end as strength,
         case when n < 2 then null when q3 - q1 = 0 or n < 5
              then case when mad <> 0 then 'MAD' end else 'IQR' end as method
  from base b join line l on b.product = l.product left join spread s on b.product = s.product),
stats as (
  select *,
         case when n < 2 then null when lo = hi then 'ZERO_VARIANCE' when cv <= 0.25e0 then 'LOW'
              when cv <= 0.75e0 then 'MEDIUM' else 'HIGH' end as volatility,
         case when strength is null then null when strength > 0.1e0 then 'INCREASING'
              when strength < -0.1e0 then 'DECREASING' else 'STABLE' end as trend,
         case when method = 'IQR' then q1 - 1.5e0 * (q3 - q1) end as lower_fence,
         case when method = 'IQR' then q3 + 1.5e0 * (q3 - q1) end as upper_fence
  from labelled)"""

FLAGS = """flags as (
  select d.product, d.date, d.units_sold, s.method,
         case method when 'IQR' then units_sold < lower_fence or units_sold > upper_fence
              when 'MAD' then abs(0.6745e0 * (units_sold - med) / mad) > 3.5e0 end as outlier
  from daily d join stats s on d.product = s.product)"""

FACTORS = """weekdays as (
  select d.product, cast(isodow(date) - 1 as integer) as k, avg(units_sold) / any_value(mean) as f
  from daily d join stats s on d.product = s.product where mean <> 0 group by all),
months as (
  select d.product, cast(month(date) as integer) as k, avg(units_sold) / any_value(mean) as f
  from daily d join stats s on d.product = s.product where mean <> 0 group by all),
weeks as (
  select d.product, count(distinct weekofyear(date)) as n_weeks
  from daily d join stats s on d.product = s.product where mean <> 0 group by d.product),
extremes as (
  select s.product, mean,
         coalesce(n_weeks, 0) as n_weeks, coalesce(w.n, 0) as n_days, coalesce(o.n, 0) as n_months,
         peak_day, drop_day, peak_mon, drop_mon,
         greatest(w.deviation, o.deviation) as deviation
  from stats s left join weeks using (product)
  left join (select product, count(*) as n, max(abs(f - 1)) as deviation,
                    arg_max(k, (f, -k)) as peak_day, arg_min(k, (f, k)) as drop_day
             from weekdays group by product) w using (product)
  left join (select product, count(*) as n, max(abs(f - 1)) as deviation,
                    arg_max(k, (f, -k)) as peak_mon, arg_min(k, (f, k)) as drop_mon
             from months group by product) o using (product))"""


def _formulas(source: str, name: str, mean: str, sd: str, stock: str, lead: str, cost: str,
              price: str) -> str:
    """Planning and financial columns as three chained CTEs, ending in `name`."""
    return f"""{name}_1 as (
  select *, case when {lead} > 0 then {mean} * {lead} end as ltd,
         case when {lead} > 0 then {sd} * sqrt({lead}) end as lsd
  from {source}),
{name}_2 as (
  select *, {Z} * lsd as ss, ltd + {Z} * lsd as rop,
         case when ltd is not null and {mean} > 0 then {stock} / {mean} end as days,
         case when lsd > 0 then ({stock} - ltd) / lsd end as zz,
         {mean} * 30e0 + {Z} * lsd as target
  from {name}_1),
{name} as (
  select *,
         case when {stock} is null or ltd is null then null
              when lsd = 0 then case when {stock} < ltd then 1e0 else 0e0 end
              else 1e0 - {_phi('zz')} end as prob,
         case when {stock} is not null and rop is not null then greatest(0e0, rop - {stock}) end as qty,
         {price} - {cost} as unit_profit, {stock} * {cost} as value,
         case when {stock} is not null and ltd is not null
              then greatest(0e0, ltd - {stock}) end as shortage,
         case when {stock} is not null and target is not null
              then greatest(0e0, {stock} - target) end as excess,
         case when {stock} is not null and ltd is not null
              then greatest(0e0, ltd - {stock}) * {price} end as rar,
         case when {stock} is not null and ltd is not null
              then greatest(0e0, ltd - {stock}) * ({price} - {cost}) end as par,
         case when {stock} is not null and target is not null
              then greatest(0e0, {stock} - target) * {cost} end as excess_value
  from {name}_2)"""


def _scores(source: str, name: str, stock: str) -> str:
    """Risk components, score and level; needs cv, trend, strength, deviation in `source`."""
    parts = {"r1": 0.30, "r2": 0.20, "r3": 0.15, "r4": 0.15, "r5": 0.10, "r6": 0.10}
    total = " + ".join(f"case when {r} is null then 0e0 else {w}e0 end" for r, w in parts.items())
    score = " + ".join(f"coalesce({r} * {w}e0, 0e0)" for r, w in parts.items())
    return f"""{name}_1 as (
  select *,
         case when prob is not null then least(prob * 100, 100e0) end as r1,
         case when cv is not null then least(cv * 50, 100e0) end as r2,
         case when trend is null then null when trend = 'STABLE' then 20e0
              when {stock} is null or rop is null or target is null then null
              else least(abs(strength) * 100, 100e0) *
                   case when trend = 'INCREASING' and {stock} < rop then 1e0
                        when trend = 'INCREASING' and {stock} > target then 0.5e0
                        when trend = 'DECREASING' and {stock} > target then 1e0
                        when trend = 'DECREASING' and {stock} < rop then 0.5e0
                        else 0.7e0 end end as r3,
         case when {stock} is null or target is null or excess is null then null
              when excess <= 0 then 0e0 when target <= 0 then null
              else least(excess / target * 100, 100e0) end as r4,
         cast(null as double) as r5,
         case when deviation is not null then least(deviation * 100, 100e0) end as r6
  from {source}),
{name}_2 as (select *, {total} as wsum, {score} as wscore from {name}_1),
{name} as (
  select *, case when risk <= 39 then 'LOW' when risk <= 69 then 'MEDIUM'
                 when risk is not null then 'HIGH' end as level
  from (select *, case when wsum > 0 then greatest(0e0, least(100e0, wscore / wsum)) end as risk
        from {name}_2))"""


def _decisions(source: str, name: str, stock: str, lead: str, mean: str) -> str:
    return f"""{name}_1 as (
  select *, case when {lead} > 0 then days / {lead} end as cover,
         case when target > 0 then excess / target end as ratio,
         ltd is null or target is null or risk is null or {stock} is null as incomplete
  from {source}),
{name}_2 as (
  select *, coalesce(prob > 0.3e0, false) as short, coalesce(ratio > 0.2e0, false) as over,
         case when trend = 'INCREASING' then 3 else 2 end as day_a,
         case when trend = 'INCREASING' then 5 else 4 end as day_b
  from {name}_1),
{name} as (
  select *, case
    when incomplete then 'DATA_INCOMPLETE'
    when short then
      case when over then
             case when prob > 0.6e0 then 'CONFLICT_STOCKOUT'
                  when ratio > 0.5e0 then 'CONFLICT_EXCESS' else 'CONFLICT_MONITOR' end
           when days <= day_a then 'STOCKOUT_CRITICAL'
           when days <= day_b then 'STOCKOUT_HIGH' else 'STOCKOUT_MEDIUM' end
    when cv > 1 and cover > 1 then 'VOLATILE_COVERED'
    when {mean} = 0 then case when excess > 100 then 'ZERO_DEMAND_EXCESS' else 'ZERO_DEMAND' end
    when over then case when ratio > 0.5e0 then 'EXCESS_HIGH' else 'EXCESS_MEDIUM' end
    when trend = 'INCREASING' and cover < 1 then 'INCREASING_LOW_COVER'
    when trend = 'DECREASING' and cover > 1.5e0 then 'DECREASING_HIGH_COVER'
    when level = 'HIGH' then 'RISK_HIGH'
    when level = 'MEDIUM' then 'RISK_MEDIUM'
    when cover < 0.5e0 then 'LOW_COVER_BUFFER'
    else 'HEALTHY' end as branch
  from {name}_2)"""


ACTION = """case
  when branch = 'DATA_INCOMPLETE' then 'UNAVAILABLE'
  when branch in ('CONFLICT_STOCKOUT', 'STOCKOUT_CRITICAL', 'STOCKOUT_HIGH', 'STOCKOUT_MEDIUM',
                  'INCREASING_LOW_COVER', 'LOW_COVER_BUFFER') then 'REORDER'
  when branch in ('CONFLICT_EXCESS', 'ZERO_DEMAND_EXCESS', 'EXCESS_HIGH', 'EXCESS_MEDIUM')
    then 'REDUCE'
  when branch in ('ZERO_DEMAND', 'DECREASING_HIGH_COVER') then 'HOLD'
  when branch = 'HEALTHY' then 'NO_ACTION' else 'MONITOR' end"""
PRIORITY = """case
  when branch in ('CONFLICT_STOCKOUT', 'STOCKOUT_CRITICAL') then 'CRITICAL'
  when branch in ('CONFLICT_EXCESS', 'STOCKOUT_HIGH', 'ZERO_DEMAND_EXCESS', 'EXCESS_HIGH',
                  'INCREASING_LOW_COVER') then 'HIGH'
  when branch in ('DATA_INCOMPLETE', 'DECREASING_HIGH_COVER', 'RISK_MEDIUM', 'LOW_COVER_BUFFER')
    then 'LOW'
  when branch = 'HEALTHY' then 'NONE' else 'MEDIUM' end"""

PRODUCTS = ",\n".join([
    """inputs as (
  select s.*, category, inventory, unit_cost, selling_price, lead_time_days, deviation,
         coalesce(sd, 0) as plan_sd
  from stats s join latest using (product) join extremes e using (product))""",
    _formulas("inputs", "planned", "mean", "plan_sd", "inventory", "lead_time_days", "unit_cost",
              "selling_price"),
    _scores("planned", "scored", "inventory"),
    _decisions("scored", "decided", "inventory", "lead_time_days", "mean"),
    f"products as (select *, {ACTION} as action, {PRIORITY} as priority from decided)",
])

REASON_CODES = """list_filter([
  case branch when 'STOCKOUT_CRITICAL' then 'COVERAGE_BELOW_LEAD'
    when 'STOCKOUT_HIGH' then case when prob > 0.5e0 then 'STOCKOUT_ELEVATED'
                                   else 'COVERAGE_BELOW_LEAD' end
    when 'STOCKOUT_MEDIUM' then 'STOCKOUT_PRESENT' when 'EXCESS_HIGH' then 'EXCESS_SIGNIFICANT'
    when 'EXCESS_MEDIUM' then 'EXCESS_PRESENT' else branch end,
  case when starts_with(branch, 'STOCKOUT_') and trend = 'INCREASING' then 'DEMAND_INCREASING' end,
  case when action = 'REORDER' then case when qty is null then 'REORDER_QTY_UNKNOWN'
                                         else 'REORDER_QTY' end end,
  case when action <> 'UNAVAILABLE' and prob > 0 then 'STOCKOUT_ESTIMATE' end,
  case when action <> 'UNAVAILABLE' and rar > 0 then 'REVENUE_AT_RISK' end,
  case when action <> 'UNAVAILABLE' and par > 0 then 'PROFIT_AT_RISK' end,
  case when action <> 'UNAVAILABLE' and excess_value > 0 then 'EXCESS_VALUE' end{more}
  ], lambda x: x is not null)"""

CATEGORIES = """cat as (
  select category, count(*) as n, count(*) filter (where level = 'HIGH') as n_high,
         avg(risk) as avg_risk, sum(value) as value, sum(value) as capital,
         sum(shortage * selling_price) as exposure, sum(excess_value) as excess_value,
         avg(cv) as volatility
  from products where risk is not null and category is not null group by category),
cats as (
  select *, case when score <= 39 then 'LOW' when score <= 69 then 'MEDIUM' else 'HIGH' end as level
  from (select *, least(100, 0.7e0 * avg_risk + 0.15e0 * value_score + 0.15e0 * high_score) as score
        from (select *, {share} as value_score, least(100e0, 200e0 * n_high / n) as high_score
              from cat)))"""
CATEGORIES_ALONE = CATEGORIES.replace("{share}", "0e0")
CATEGORIES_OF_TOTAL = CATEGORIES.replace(
    "{share}", "least(100e0, 100e0 * value / (select sum(value) from products "
               "where risk is not null))")

OVERALL = """overall as (
  select (select avg(score) from cats) as score,
         (select count(*) from products) as total_products,
         (select count(*) from products where level in ('MEDIUM', 'HIGH')) as products_at_risk,
         (select count(*) from cats) as total_categories,
         (select count(*) from cats where level = 'HIGH') as high_risk_categories,
         (select sum(exposure) from cats where exposure > 0) as exposure,
         (select sum(excess_value) from cats where excess_value > 0) as excess_value,
         (select sum(capital) from cats where capital > 0) as capital,
         (select sum(rar) from products) as rar, (select sum(par) from products) as par)"""
STATUS = ("case when score <= 39 then 'HEALTHY' when score <= 69 then 'ATTENTION' "
          "when score is not null then 'CRITICAL' end")

SINGLE = """grid as (
  select * from (values ('none', cast(null as double), cast(null as double)), ('demand', 0.1e0, null),
                        ('lead', null, 3e0), ('both', -0.25e0, 2.5e0), ('negative', -1.5e0, null),
                        ('early', null, -100e0)) as t(scenario_id, change, extra))"""
GRID = """grid as (
  select concat('d', pct, '_l', lead) as scenario_id, pct / 100e0 as change,
         cast(lead as double) as extra
  from (select unnest([-50, -20, 0, 20, 100]) as pct) a,
       (select unnest([-5, 0, 3, 14]) as lead) b)"""

ASSUMED = ("cast(null as double) as cv, 'STABLE' as trend, 0e0 as strength, "
           "cast(null as double) as deviation")
WHAT_IF = ",\n".join([
    GRID,
    f"""start as (
  select product, coalesce(mean, 0) as b_mean, plan_sd as sd, inventory, lead_time_days as b_lead,
         unit_cost, selling_price, {ASSUMED} from inputs)""",
    _formulas("start", "bp", "b_mean", "sd", "inventory", "b_lead", "unit_cost", "selling_price"),
    _scores("bp", "bs", "inventory"),
    _decisions("bs", "bd", "inventory", "b_lead", "b_mean"),
    """tried as (
  select s.*, scenario_id, change, extra, b_mean * (1 + coalesce(change, 0)) as w_mean,
         b_lead + coalesce(extra, 0) as w_lead
  from start s cross join grid)""",
    _formulas("tried", "wp", "w_mean", "sd", "inventory", "w_lead", "unit_cost", "selling_price"),
    _scores("wp", "ws", "inventory"),
    _decisions("ws", "wd", "inventory", "w_lead", "w_mean"),
    f"""compared as (
  select w.*, {ACTION.replace('branch', 'w.branch')} as w_action,
         {PRIORITY.replace('branch', 'w.branch')} as w_priority,
         {ACTION.replace('branch', 'b.branch')} as b_action,
         {PRIORITY.replace('branch', 'b.branch')} as b_priority,
         {', '.join(f'b.{c} as b_{c}' for c in ['ltd', 'ss', 'rop', 'prob', 'qty', 'days',
                                                'target', 'excess', 'excess_value', 'rar', 'par',
                                                'risk', 'level'])},
         case when w_mean < 0 then {_text(m.NEGATIVE_SCENARIO_DEMAND)}
              when extra is not null and (w.b_lead is null or w.b_lead <= 0)
                then {_text(m.NO_BASELINE_LEAD_TIME)}
              when extra is not null and w_lead <= 0 then {_text(m.SCENARIO_LEAD_TIME)} end as problem
  from wd w join bd b on w.product = b.product)""",
])
COMPARED = {"mean_demand": ("b_mean", "w_mean"), "lead_time_days": ("b_lead", "w_lead"),
            "lead_time_demand": ("b_ltd", "ltd"), "safety_stock": ("b_ss", "ss"),
            "reorder_point": ("b_rop", "rop"), "stockout_probability": ("b_prob", "prob"),
            "reorder_quantity": ("b_qty", "qty"), "days_remaining": ("b_days", "days"),
            "target_stock": ("b_target", "target"), "excess_units": ("b_excess", "excess"),
            "excess_inventory_value": ("b_excess_value", "excess_value"),
            "revenue_at_risk": ("b_rar", "rar"), "profit_at_risk": ("b_par", "par"),
            "risk_score": ("b_risk", "risk")}
WORDS = {"risk_level": ("b_level", "level"), "action": ("b_action", "w_action"),
         "priority": ("b_priority", "w_priority")}

TO_DAILY = [FEED, DAILY]
TO_STATS = [*TO_DAILY, STATS]
TO_PRODUCTS = [*TO_STATS, FACTORS, PRODUCTS]


def _query(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + select


def _r(mapping: dict[str, str], places: int = 6) -> str:
    """select list: rounded expressions under their output names."""
    return ", ".join(f"round({text}, {places}) as {name}" for name, text in mapping.items())


def _named(names: list[str], titles: list[str], key: str, first: int) -> str:
    arms = " ".join(f"when {k} then {_text(t)}" for k, t in enumerate(titles, first))
    return f"case {key} {arms} end as {names}"


def _validation(blocked: str) -> str:
    """Report over the feed with faults put in, as counts per check."""
    faulty = f"""faulty as (
  select case when {blocked} and seq % 967 = 0 then 'not-a-date' else cast(date as varchar) end as date,
         product, case when seq % 983 = 0 then null else category end as category,
         case when {blocked} and seq % 953 = 0 then 'not-a-number'
              else cast(inventory as varchar) end as inventory,
         case when seq % 997 = 0 then -5 else units_sold end as units_sold,
         case when seq % 977 = 0 then null else unit_cost end as unit_cost,
         case when seq % 971 = 0 then -1.5e0 else selling_price end as selling_price,
         supplier, case when seq % 991 = 0 then 0 else lead_time_days end as lead_time_days
  from feed)"""
    return _report([FEED, faulty], "faulty")


def _report(ctes: list[str], table: str) -> str:
    def counted(check: str, severity: str, column: str, condition: str, message: str) -> str:
        return (f"select '{check}' as \"check\", '{severity}' as severity, '{column}' as \"column\", "
                f"count(*) filter (where {condition}) as n_rows, {_text(message)} as template "
                f"from {table}")

    bad_date = "date is not null and try_cast(date as date) is null"
    parts = [counted("INVALID_DATE", "ERROR", "date", bad_date, m.INVALID_DATES)]
    numeric = ["inventory", "units_sold", "unit_cost", "selling_price", "lead_time_days"]
    for c in numeric:
        parts.append(counted("NOT_NUMERIC", "ERROR", c,
                             f"{c} is not null and try_cast({c} as double) is null",
                             m.NOT_NUMERIC.format(c)))
    for c in numeric[:4]:
        parts.append(counted("NEGATIVE", "ERROR", c, f"try_cast({c} as double) < 0",
                             m.NEGATIVE_VALUES.format(c)))
    parts.append(counted("LEAD_TIME", "ERROR", "lead_time_days",
                         "try_cast(lead_time_days as double) <= 0", m.LEAD_TIME_NOT_POSITIVE))
    parts.append(f"select 'DUPLICATE', 'WARNING', 'product,date', coalesce(sum(n), 0), "
                 f"{_text(m.DUPLICATE_RECORDS)} from (select count(*) as n from {table} "
                 f"group by product, date having count(*) > 1)")
    parts.append(counted("MISSING_INVENTORY", "WARNING", "inventory", "inventory is null",
                         m.MISSING_INVENTORY))
    for c in ["product", "category", "supplier", "unit_cost", "selling_price", "lead_time_days"]:
        parts.append(counted("MISSING", "ERROR", c, f"{c} is null", m.MISSING_VALUES.format(c)))
    types = "\"check\" in ('INVALID_DATE', 'NOT_NUMERIC')"
    return _query(
        [*ctes, "found as (" + "\nunion all ".join(parts) + ")"],
        f"select \"check\", severity, \"column\", cast(n_rows as bigint) as n_rows, "
        f"replace(template, '{{}}', cast(cast(n_rows as bigint) as varchar)) as message "
        f"from found where n_rows > 0 and ({types} or not exists "
        f"(select 1 from found where {types} and n_rows > 0))")


def _warnings() -> str:
    """Long form of the per-stage warnings."""
    stocked, patterned = "inventory is not null", "p.mean <> 0"
    planning = [("not coalesce(lead_time_days > 0, false)", m.BAD_LEAD_TIME),
                ("lead_time_days > 0 and inventory is null", m.NO_INVENTORY_PLANNING),
                (f"lead_time_days > 0 and {stocked} and not (p.mean > 0)", m.ZERO_MEAN_COVER),
                (f"lead_time_days > 0 and {stocked} and lsd = 0", m.ZERO_VARIABILITY)]
    stages = {
        "demand": [("n = 1", m.NO_SAMPLE_DEVIATION), ("n > 1 and p.mean <= 0", m.ZERO_MEAN_CV)],
        "trend": [("n < 2", m.NO_TREND), ("n > 1 and p.mean = 0", m.ZERO_MEAN_TREND)],
        "outlier": [("n < 2", m.NO_OUTLIERS), ("n > 1 and method is null", m.ZERO_MAD)],
        "pattern": [
            ("p.mean = 0", m.ZERO_MEAN_SEASONALITY),
            (f"{patterned} and (n_weeks < 4 or n_days < 2)", (m.FEW_WEEKS, "n_weeks")),
            (f"{patterned} and n_months >= 2 and n_months < 12", (m.SHORT_HISTORY, "n_months")),
            (f"{patterned} and n_months < 2", m.FEW_MONTHS)],
        "planning": planning,
        "financial": [("inventory is null", m.NO_INVENTORY_FINANCIAL), *planning],
        "risk": [
            ("prob is null", m.NO_STOCKOUT_SCORE), ("cv is null", m.NO_VOLATILITY_SCORE),
            ("trend is null", m.NO_TREND_SCORE),
            ("trend <> 'STABLE' and inventory is null", m.TREND_WITHOUT_INVENTORY),
            (f"trend <> 'STABLE' and {stocked} and (rop is null or target is null)",
             m.TREND_WITHOUT_THRESHOLDS),
            ("excess is null", m.NO_EXCESS_SCORE),
            ("excess > 0 and target <= 0", m.EXCESS_WITHOUT_TARGET),
            ("rar is null", m.NO_REVENUE_AT_RISK), ("rar is not null", m.NO_REFERENCE),
            ("p.deviation is null", m.NO_SEASONALITY_SCORE), ("risk is null", m.NO_COMPONENTS)],
    }

    def wording(text) -> str:
        if isinstance(text, tuple):
            return f"replace({_text(text[0])}, '{{}}', cast({text[1]} as varchar))"
        return _text(text)

    parts = []
    for stage, found in stages.items():
        items = ", ".join(f"case when {c} then {wording(t)} end" for c, t in found)
        parts.append(f"select product, '{stage}' as stage, list_filter([{items}], "
                     f"lambda x: x is not null) as texts from products p join extremes using (product)")
    return _query(
        [*TO_PRODUCTS, "found as (" + "\nunion all ".join(parts) + ")"],
        "select product, stage, cast(i - 1 as integer) as position, texts[i] as warning "
        "from (select *, unnest(range(1, len(texts) + 1)) as i from found)")


IN_CONTEXT = """,
  case when action <> 'UNAVAILABLE' and cat_level = 'HIGH' then 'CATEGORY_HIGH' end,
  case when action <> 'UNAVAILABLE' and status = 'CRITICAL' then 'OVERALL_CRITICAL' end"""


def _wording(template: str, values: list[str]) -> str:
    pieces = template.split("{}")
    parts = [_text(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, _text(piece)]
    return " || ".join(parts)


def _reason_text(code: str) -> str:
    """The sentence of a code; numbers by printf, which rounds the double that they are."""
    values = {
        "COVERAGE_BELOW_LEAD": ["printf('%.1f', days)", "printf('%.1f', lead_time_days)"],
        "STOCKOUT_ELEVATED": ["printf('%.1f', prob * 100) || '%'"],
        "STOCKOUT_ESTIMATE": ["printf('%.1f', prob * 100) || '%'"],
        "EXCESS_SIGNIFICANT": ["printf('%.1f', ratio * 100) || '%'"],
        "REORDER_QTY": ["printf('%.1f', qty)"],
        "REVENUE_AT_RISK": ["printf('%.2f', rar)"],
        "PROFIT_AT_RISK": ["printf('%.2f', par)"],
        "EXCESS_VALUE": ["printf('%.2f', excess_value)"],
        "CATEGORY_HIGH": ["category"],
    }
    arms = " ".join(f"when {_text(name)} then {_wording(text, values.get(name, []))}"
                    for name, text in m.REASONS.items())
    return f"case {code} {arms} end"


def _reason_rows(ctes: list[str], source: str, more: str = "", wanted: str = "codes[i] as code") -> str:
    codes = REASON_CODES.replace("{more}", more)
    return _query(ctes, f"select product, cast(i - 1 as integer) as position, {wanted} from "
                        f"(select *, unnest(range(1, len(codes) + 1)) as i from "
                        f"(select *, {codes} as codes from {source}))")


REASON = f"{_reason_text('codes[i]')} as reason"


def _leaves(keys: str, source: str, fields: dict[str, str], places: int = 6) -> str:
    """A row for each field: paths that start with # are numbers, the others texts."""
    rows = ", ".join(
        f"struct_pack(path := {_text(path.lstrip('#'))}, "
        + (f"number := round(cast({text} as double), {places}), text := cast(null as varchar))"
           if path.startswith("#") else f"number := cast(null as double), text := cast({text} as varchar))")
        for path, text in fields.items())
    return (f"select {keys}, leaf.path as path, leaf.number as number, leaf.text as text "
            f"from (select {keys}, unnest([{rows}]) as leaf from {source})")


def _topic(topic: str, fields: dict[str, str]) -> dict[str, str]:
    return {("#" if k.startswith("#") else "") + f"{topic}.{k.lstrip('#')}": v for k, v in fields.items()}


CONTEXT = {"mean_demand": "mean", "cv": "cv", "trend_strength": "strength",
           "current_inventory": "inventory", "days_remaining": "days",
           "lead_time_days": "lead_time_days", "safety_stock": "ss", "reorder_point": "rop",
           "reorder_quantity": "qty", "stockout_probability": "prob", "excess_units": "excess",
           "excess_inventory_value": "excess_value", "revenue_at_risk": "rar",
           "profit_at_risk": "par", "risk_score": "risk"}
RANK = ("case priority when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 "
        "when 'LOW' then 3 when 'NONE' then 4 else 99 end")
ISSUE = ("case action when 'REORDER' then 'Stockout risk' when 'REDUCE' then 'Excess inventory' "
         "when 'HOLD' then 'Low demand' when 'MONITOR' then 'Volatility / trend' "
         "else 'Healthy' end")
EXPLORER = (f"select product, coalesce(category, 'N/A') as category, "
            f"round(coalesce(risk, 0), 6) as risk_score, coalesce(level, 'N/A') as risk_level, "
            f"action, priority, {ISSUE} as main_issue, round(prob, 6) as stockout_probability, "
            f"round(excess, 6) as excess_units, round(ratio, 6) as excess_ratio from products")
CATEGORY_SELECT = (
    "select category, n as product_count, n_high as high_risk_product_count, "
    + _r({"average_product_risk_score": "avg_risk", "demand_volatility": "volatility",
          "value_score": "value_score", "high_risk_score": "high_score", "risk_score": "score"}) + ", "
    + _r({"inventory_value": "value", "capital_tied_up": "capital", "stockout_exposure": "exposure",
          "excess_inventory_value": "excess_value"}, 3)
    + ", level as risk_level from cats")
DAILY_SELECT = (
    "select product, date, category, supplier, "
    + _r({c: c for c in ["inventory", "units_sold", "unit_cost", "selling_price",
                         "lead_time_days", "daily_revenue", "daily_profit", "inventory_value",
                         "opening_inventory"]})
    + ", round(inventory - opening_inventory, 6) as inventory_change, "
      "round(units_sold, 6) as sales_velocity, "
      "round(case when daily_revenue > 0 then daily_profit / daily_revenue else 0 end, 6) "
      "as profit_margin from daily")


STATE = {"category": "category", "#current_inventory": "inventory", "#unit_cost": "unit_cost",
         "#selling_price": "selling_price", "#lead_time_days": "lead_time_days"}
DEMAND = {"#observation_count": "n", "#mean_demand": "mean", "#median_demand": "med", "#std_dev": "sd",
          "#variance": "variance", "#cv": "cv", "#min_demand": "lo", "#max_demand": "hi",
          "#zero_demand_days": "zero_days", "volatility": "volatility"}
TREND = {"#slope": "slope", "#intercept": "intercept", "#trend_strength": "strength", "trend": "trend",
         "trend_significant": "trend in ('INCREASING', 'DECREASING')"}
OUTLIERS = {"#q1": "q1", "#q3": "q3", "#mad": "mad", "outlier_method": "method",
            "#lower_fence": "lower_fence", "#upper_fence": "upper_fence",
            "#outlier_count": "case when method is not null then (select count(*) from flags f "
                              "where f.product = p.product and outlier) end"}
PATTERN = {"#mean_demand": "p.mean", "#weeks_observed": "n_weeks", "#weekdays_observed": "n_days",
           "#months_observed": "n_months", "weekday_pattern_available": "n_weeks >= 4 and n_days >= 2",
           "monthly_pattern_label": f"case when n_months >= 12 then {_text(m.ANNUAL_PATTERN)} "
                                    f"when n_months >= 2 then {_text(m.OBSERVED_PATTERN)} end",
           **{name: _named(name, titles, key, first).rsplit(" as ", 1)[0] for name, titles, key, first in (
               ("peak_weekday", m.WEEKDAYS, "peak_day", 0), ("drop_weekday", m.WEEKDAYS, "drop_day", 0),
               ("peak_month", m.MONTHS, "peak_mon", 1), ("drop_month", m.MONTHS, "drop_mon", 1))},
           "#seasonal_deviation": "p.deviation"}
PLANNING = {"#lead_time_demand": "ltd", "#lead_time_sd": "lsd", "#safety_stock": "ss", "#reorder_point": "rop",
            "#days_remaining": "days", "#stockout_probability": "prob", "#reorder_quantity": "qty"}
FINANCIAL = {"#profit_per_unit": "unit_profit", "#inventory_value": "value", "#capital_tied_up": "value",
             "#shortage_units": "shortage", "#revenue_at_risk": "rar", "#profit_at_risk": "par",
             "#target_stock": "target", "#excess_units": "excess", "#excess_inventory_value": "excess_value"}
RISK = {**{f"#{name}_score": f"r{n}" for n, name in enumerate(
    ["stockout_exposure", "demand_volatility", "demand_trend", "excess_inventory", "financial_exposure",
     "seasonality"], 1)}, "#available_weight_sum": "wsum", "#risk_score": "risk", "risk_level": "level"}
EVIDENCE = {"#mean_demand": "mean", "#cv": "cv", "trend": "trend", "#trend_strength": "strength",
            "#stockout_probability": "prob", "#days_remaining": "days", "#lead_time_demand": "ltd",
            "#reorder_point": "rop", "#reorder_quantity": "qty", "#target_stock": "target",
            "#excess_units": "excess", "#excess_inventory_value": "excess_value", "#revenue_at_risk": "rar",
            "#profit_at_risk": "par", "risk_level": "level", "#risk_score": "risk"}
SUGGESTION = {"#coverage_ratio": "cover", "#excess_ratio": "ratio", "branch": "branch", "action": "action",
              "priority": "priority", "#suggested_quantity": "case when action <> 'UNAVAILABLE' then qty end"}
BRIEF = {"product": "product", "category": "category", "#mean_demand": "mean", "#cv": "cv", "trend": "trend",
         "#trend_strength": "strength", "#current_inventory": "inventory", "#days_remaining": "days",
         "#lead_time_days": "lead_time_days", "#safety_stock": "ss", "#reorder_point": "rop",
         "#reorder_quantity": "qty", "#stockout_probability": "prob", "#excess_units": "excess",
         "#excess_inventory_value": "excess_value", "#revenue_at_risk": "rar", "#profit_at_risk": "par",
         "#risk_score": "risk", "risk_level": "level", "recommendation_action": "action",
         "recommendation_priority": "priority", **_topic("recommendation_evidence", EVIDENCE)}


def _elements(path: str, rows: str, place: str, text: str) -> str:
    """Rows with a position as the elements of an array."""
    return (f"select product, concat({path}, '[', {place}, ']') as path, cast(null as double) as number, "
            f"{text} as text from ({rows})")


def _entries(path: str, rows: str, key: str, value: str) -> str:
    return (f"select product, concat('{path}{{', {key}, '}}') as path, round({value}, 6) as number, "
            f"cast(null as varchar) as text from ({rows})")


def _profile_leaves(statements: dict[str, str], where: str = "") -> str:
    """Every leaf of the nested profile, from the tables that hold its parts."""
    topics = [STATE, _topic("demand", DEMAND), _topic("trend_result", TREND), _topic("outliers", OUTLIERS),
              _topic("pattern", PATTERN), _topic("planning", PLANNING), _topic("financial", FINANCIAL),
              _topic("risk", RISK), _topic("recommendation", SUGGESTION),
              _topic("recommendation.evidence", EVIDENCE)]
    topic_of = ("case stage when 'trend' then 'trend_result' when 'outlier' then 'outliers' else stage end")
    parts = [
        _query([*TO_PRODUCTS, FLAGS, "wide as (select p.*, e.* exclude (product, mean, deviation) "
                                     "from products p join extremes e using (product))"],
               _leaves("product", "wide p", {k: v for topic in topics for k, v in topic.items()})),
        _elements(f"{topic_of}, '.', stage, '_warnings'", statements["product_warnings"], "position", "warning"),
        _elements("'recommendation.gate_warnings'", statements["recommendation_warnings"], "position", "warning"),
        _elements("'recommendation.reason_codes'", statements["recommendation_reasons"], "position", "code"),
        _elements("'recommendation.reasons'", statements["recommendation_reason_texts"], "position", "reason"),
        _entries("pattern.weekday_factors", statements["weekday_factors"], "weekday", "factor"),
        _entries("pattern.monthly_factors", statements["monthly_factors"], "month", "factor"),
        _entries("risk.weights_used", statements["risk_weights"], "component", "weight"),
    ]
    return f"select * from ({' union all '.join(f'select * from ({part})' for part in parts)}) {where}"


def _context_leaves(keys: str, source: str) -> str:
    """The context records of the products in source, which has their keys too."""
    codes = REASON_CODES.replace("{more}", "")
    listed = (f"select {keys}, concat('recommendation_reasons[', i - 1, ']') as path, cast(null as double) as number, "
              f"{_reason_text('codes[i]')} as text from (select *, unnest(range(1, len(codes) + 1)) as i "
              f"from (select *, {codes} as codes from {source}))")
    return f"{_leaves(keys, source, BRIEF)} union all {listed}"


def _brief() -> str:
    none = "cast(null as integer)"
    overall = {"#overall_risk_score": "score", "overall_health_status": STATUS, "#total_products": "total_products",
               "#products_at_risk": "products_at_risk", "#total_categories": "total_categories",
               "#high_risk_categories": "high_risk_categories", "#total_stockout_exposure": "exposure",
               "#total_excess_inventory_value": "excess_value", "#total_capital_tied_up": "capital",
               "#total_revenue_at_risk": "case when rar > 0 then rar end",
               "#total_profit_at_risk": "case when par > 0 then par end"}
    keys = 'section, position, "key"'
    top = ("top as (select 'product' as section, product as \"key\", cast(row_number() over (order by "
           "coalesce(risk, 0) desc, product) as integer) as position, * from products "
           "order by coalesce(risk, 0) desc, product limit 10)")
    rows = [
        _leaves(keys, f"(select 'overall' as section, 1 as position, cast(null as varchar) as \"key\", * from overall)",
                overall, 3),
        _leaves(keys, f"(select 'category' as section, {none} as position, category as \"key\", * from cats)",
                {"category": "category", "risk_level": "level"}),
        _context_leaves(keys, "top"),
    ]
    return _query([*TO_PRODUCTS, CATEGORIES_ALONE, OVERALL, top], " union all ".join(rows))


def _planning_notes() -> str:
    lead, price = "coalesce(lead_time_days > 0, false)", "(case when product like '%7' then 0 else selling_price end)"
    notes = [(f"mean > 0 and mean * {price} <= 0", m.ZERO_REVENUE),
             ("inventory is null", m.NO_INVENTORY_FINANCIAL),
             (f"not {lead}", m.BAD_LEAD_TIME), (f"{lead} and sd is null", m.NO_VARIABILITY),
             (f"{lead} and sd is not null and inventory is null", m.NO_INVENTORY_PLANNING),
             (f"{lead} and sd is not null and inventory is not null and not coalesce(mean > 0, false)",
              m.ZERO_MEAN_COVER),
             (f"{lead} and inventory is not null and sd = 0", m.ZERO_VARIABILITY)]
    listed = ", ".join(f"case when {c} then {_text(t)} end" for c, t in notes)
    return _query(TO_PRODUCTS, "select product, cast(i - 1 as integer) as position, texts[i] as warning "
                  "from (select *, unnest(range(1, len(texts) + 1)) as i from (select product, "
                  f"list_filter([{listed}], lambda x: x is not null) as texts from products))")


def _by_level() -> str:
    priced = {"lead_time_demand": "ltd", "lead_time_sd": "lsd", "safety_stock": "ss", "reorder_point": "rop",
              "days_remaining": "days", "stockout_probability": "prob", "reorder_quantity": "qty"}
    at = """levelled as (
  select product, coalesce(mean, 0) as b_mean, plan_sd, inventory, lead_time_days, unit_cost, selling_price,
         service_level, z from inputs cross join levels)"""
    planned = _formulas("levelled", "leveled", "b_mean", "plan_sd", "inventory", "lead_time_days", "unit_cost",
                        "selling_price").replace(Z, "z")
    ctes = [*TO_PRODUCTS, _levels([0.5, 0.8, 0.9, 0.95, 0.975, 0.99, 0.999, 1.0]), at, planned]
    return _query(ctes, "select product, round(service_level, 9) as service_level, round(z, 9) as z_score, "
                  + _r(priced) + " from leveled").replace("with ", "with recursive ", 1)


STRICT = {"<= 39": "<= 10", "<= 69": "<= 20"}


def _strictly(text: str) -> str:
    for usual, strict in STRICT.items():
        text = text.replace(usual, strict)
    return text


def _what_if_select(kinds: set[str]) -> str:
    parts = ["select product, scenario_id, problem as scenario_error"]
    if "values" in kinds:
        parts += ["round(change, 6) as mean_demand_change_pct", "round(extra, 6) as lead_time_days_change",
                  _r({f"base_{k}": b for k, (b, _) in COMPARED.items()}),
                  _r({f"scenario_{k}": f"case when problem is null then {w} end" for k, (_, w) in COMPARED.items()}),
                  *[f"{b} as base_{k}, case when problem is null then {w} end as scenario_{k}"
                    for k, (b, w) in WORDS.items()]]
    if "deltas" in kinds:
        parts += ["case when problem is null then case when risk > b_risk then 'increases' "
                  "when risk < b_risk then 'decreases' when risk = b_risk then 'unchanged' end end as direction",
                  _r({f"delta_{k}": f"case when problem is null then {w} - {b} end" for k, (b, w) in COMPARED.items()})]
    return ", ".join(parts) + " from compared"


def _stats_select() -> str:
    return ("select product, n as observation_count, "
            + _r({"mean_demand": "mean", "median_demand": "med", "std_dev": "sd",
                  "variance": "variance", "cv": "cv", "min_demand": "lo", "max_demand": "hi"})
            + ", zero_days as zero_demand_days, volatility from stats")


def _enriched() -> list[str]:
    return [*TO_PRODUCTS, CATEGORIES_ALONE, OVERALL,
            f"""wide as (
  select p.*, c.level as cat_level, c.score as cat_score, (select {STATUS} from overall) as status
  from products p left join cats c on p.category = c.category)"""]


def statements() -> dict[str, str]:
    found = _flat_statements()
    found["product_profile_nested"] = _profile_leaves(found)
    found["product_detail"] = _profile_leaves(found, "where product = 'P000007'")
    return found


def _flat_statements() -> dict[str, str]:
    priced = {"lead_time_demand": "ltd", "lead_time_sd": "lsd", "safety_stock": "ss",
              "reorder_point": "rop", "days_remaining": "days", "stockout_probability": "prob",
              "reorder_quantity": "qty"}
    risk = dict(zip(["stockout_exposure_score", "demand_volatility_score", "demand_trend_score",
                     "excess_inventory_score", "financial_exposure_score", "seasonality_score",
                     "available_weight_sum", "risk_score"],
                    ["r1", "r2", "r3", "r4", "r5", "r6", "wsum", "risk"]))
    gate = [("n = 0", m.GATE_NO_DEMAND), ("ltd is null", m.GATE_NO_LEAD_DEMAND),
            ("target is null", m.GATE_NO_TARGET), ("risk is null", m.GATE_NO_SCORE),
            ("inventory is null", m.GATE_NO_INVENTORY)]
    gate_list = ", ".join(f"case when {c} then {_text(t)} end" for c, t in gate)
    weights = [("stockout_exposure", "r1", 0.3), ("demand_volatility", "r2", 0.2),
               ("demand_trend", "r3", 0.15), ("excess_inventory", "r4", 0.15),
               ("financial_exposure", "r5", 0.1), ("seasonality", "r6", 0.1)]
    events = [("DEMAND_SPIKE", "outlier", "units_sold"), ("STOCKOUT", "inventory = 0", "inventory"),
              ("REPLENISHMENT", "inventory > coalesce(opening_inventory, 0) * 1.2e0", "inventory"),
              ("SAFETY_STOCK_BREACH", "inventory < ss", "inventory")]
    return {
        "reorder_report": _query(TO_PRODUCTS, "select product, category, " + _r(
            {k: v for k, v in priced.items() if k != "lead_time_sd"})
            + ", round(risk, 6) as risk_score, level as risk_level, action, priority from products"),
        "validation_report": _report([FEED], "feed"),
        "validation_report_faulty": _validation("false"),
        "validation_report_blocked": _validation("true"),
        "validation_verdict":
            "select count(*) filter (where severity = 'ERROR') = 0 as is_valid, "
            "count(*) filter (where severity = 'ERROR') as n_errors, "
            "count(*) filter (where severity = 'WARNING') as n_warnings "
            f"from ({_report([FEED], 'feed')})",
        "daily_processed": _query(TO_DAILY, DAILY_SELECT),
        "daily_from_csv": _query(TO_DAILY, DAILY_SELECT),
        "daily_from_parquet": _query(TO_DAILY, DAILY_SELECT),
        "filtered_daily": _query(TO_DAILY, DAILY_SELECT + (
            " where date between date '1994-01-01' and date '1996-12-31' "
            "and category in ('PROMO', 'SMALL', 'LARGE') "
            "and regexp_matches(lower(product), '[13579]$')")),
        "date_bounds": _query([FEED], "select min(date) as min_date, max(date) as max_date from feed"),
        "category_list": _query(TO_DAILY, "select distinct category from daily "
                                          "where category is not null order by category"),
        "demand_stats": _query(TO_STATS, _stats_select()),
        "filtered_demand_stats": _query(
            [FEED, DAILY.replace("daily as (", "every_day as ("),
             "daily as (select * from every_day where date >= date '1995-01-01' "
             "and date <= date '1996-12-31')", STATS], _stats_select()),
        "demand_trend": _query(TO_STATS, "select product, " + _r(
            {"slope": "slope", "intercept": "intercept", "trend_strength": "strength"})
            + ", trend, trend in ('INCREASING', 'DECREASING') as trend_significant from stats"),
        "outlier_bounds": _query([*TO_STATS, FLAGS], "select s.product, " + _r(
            {"q1": "q1", "q3": "q3", "mad": "mad", "lower_fence": "lower_fence",
             "upper_fence": "upper_fence"})
            + ", s.method as outlier_method, case when s.method is not null then "
              "(select count(*) from flags f where f.product = s.product and outlier) end "
              "as outlier_count from stats s"),
        "outlier_rows": _query([*TO_STATS, FLAGS], "select product, date, round(units_sold, 6) "
                               "as units_sold, method as outlier_method from flags where outlier"),
        "weekday_factors": _query([*TO_STATS, FACTORS],
                                  "select product, k as weekday, round(f, 6) as factor from weekdays"),
        "monthly_factors": _query([*TO_STATS, FACTORS],
                                  "select product, k as month, round(f, 6) as factor from months"),
        "seasonality_summary": _query(
            [*TO_STATS, FACTORS],
            "select product, round(mean, 6) as mean_demand, cast(n_weeks as integer) as weeks_observed, "
            "cast(n_days as integer) as weekdays_observed, "
            "cast(n_months as integer) as months_observed, "
            "n_weeks >= 4 and n_days >= 2 as weekday_pattern_available, "
            f"case when n_months >= 12 then {_text(m.ANNUAL_PATTERN)} "
            f"when n_months >= 2 then {_text(m.OBSERVED_PATTERN)} end as monthly_pattern_label, "
            + ", ".join([_named("peak_weekday", m.WEEKDAYS, "peak_day", 0),
                         _named("drop_weekday", m.WEEKDAYS, "drop_day", 0),
                         _named("peak_month", m.MONTHS, "peak_mon", 1),
                         _named("drop_month", m.MONTHS, "drop_mon", 1)])
            + ", round(deviation, 6) as seasonal_deviation from extremes"),
        "inventory_planning": _query(TO_PRODUCTS, f"select product, {_r(priced)} from products"),
        "financial_metrics": _query(TO_PRODUCTS, "select product, " + _r(
            {"profit_per_unit": "unit_profit", "inventory_value": "value",
             "capital_tied_up": "value", "shortage_units": "shortage", "revenue_at_risk": "rar",
             "profit_at_risk": "par", "target_stock": "target", "excess_units": "excess",
             "excess_inventory_value": "excess_value"}) + " from products"),
        "financial_with_sales": _query(TO_PRODUCTS, "select product, " + _r(
            {"daily_revenue": "mean * selling_price", "daily_cogs": "mean * unit_cost",
             "daily_profit": "mean * selling_price - mean * unit_cost",
             "profit_per_unit": "selling_price - unit_cost",
             "gross_margin": "case when mean * selling_price > 0 then (mean * selling_price "
                             "- mean * unit_cost) / (mean * selling_price) "
                             "else mean * 0 end"}) + " from products"),
        "product_risk": _query(TO_PRODUCTS, f"select product, {_r(risk)}, level as risk_level "
                                            f"from products"),
        "risk_weights": _query(TO_PRODUCTS, "\nunion all ".join(
            f"select product, '{n}' as component, {w}e0 as weight from products "
            f"where {r} is not null" for n, r, w in weights)),
        "recommendations": _query(TO_PRODUCTS, "select product, category, " + _r(
            {"coverage_ratio": "cover", "excess_ratio": "ratio"})
            + ", branch, action, priority, round(case when action <> 'UNAVAILABLE' then qty end, 6) "
              "as suggested_quantity from products"),
        "recommendation_reasons": _reason_rows(TO_PRODUCTS, "products"),
        "recommendation_warnings": _query(
            TO_PRODUCTS, "select product, cast(i - 1 as integer) as position, texts[i] as warning "
            "from (select *, unnest(range(1, len(texts) + 1)) as i from (select product, "
            f"list_filter([{gate_list}], lambda x: x is not null) as texts from products))"),
        "recommendations_enriched": _query(
            _enriched(), "select product, category, action, priority, cat_level as "
            "category_risk_level, round(cat_score, 6) as category_risk_score, "
            "status as overall_health_status from wide"),
        "enriched_reasons": _reason_rows(_enriched(), "wide", IN_CONTEXT),
        "enriched_reasons_strict": _strictly(_reason_rows(
            _enriched(), "wide", IN_CONTEXT, f"codes[i] as code, {REASON}")),
        "recommendation_reason_texts": _reason_rows(TO_PRODUCTS, "products", wanted=REASON),
        "recommendation_evidence": _query(TO_PRODUCTS, _leaves(
            "product", "products", _topic("evidence", EVIDENCE))),
        "planning_notes": _planning_notes(),
        "planning_by_service_level": _by_level(),
        "product_risk_with_reference": _query(
            [*TO_STATS, FACTORS, PRODUCTS.replace(
                "cast(null as double) as r5", "case when rar is not null and (select max(rar) from planned) > 0 "
                "then least(rar / (select max(rar) from planned) * 100, 100e0) end as r5")],
            f"select product, {_r(risk)}, level as risk_level from products"),
        "validation_missing_columns":
            "select 'MISSING_COLUMN' as \"check\", 'ERROR' as severity, 'supplier,lead_time_days' as \"column\", "
            "cast(2 as bigint) as n_rows, 'Missing required columns: [''supplier'', ''lead_time_days'']' as message",
        "category_warnings": _query(
            [*TO_PRODUCTS, CATEGORIES_ALONE.replace(
                "from products where risk is not null and category is not null",
                "from (select * replace (case when category <> 'PROMO' then risk end as risk) from products) "
                "where category is not null")],
            "select category, n as product_count, case when avg_risk is not null then level end as risk_level, "
            f"case when avg_risk is null then {_wording(m.NO_CATEGORY_SCORES, ['category'])} end as warning from cats"),
        "overall_health_empty":
            "select cast(null as double) as overall_risk_score, cast(null as varchar) as overall_health_status, "
            "0 as total_products, 0 as products_at_risk, 0 as total_categories, 0 as high_risk_categories, "
            + ", ".join(f"cast(null as double) as {name}" for name in (
                "total_stockout_exposure", "total_excess_inventory_value", "total_capital_tied_up",
                "total_revenue_at_risk", "total_profit_at_risk"))
            + ", 'No category or product data available for overall health.' as warning",
        "scenario_single": _query([*TO_PRODUCTS, WHAT_IF.replace(GRID, SINGLE)],
                                  _what_if_select({"values", "deltas"})),
        "brief_context": _brief(),
        "product_context": _query(
            [*TO_PRODUCTS, "one as (select * from products where product = 'P000007')"],
            f"select path, number, text from ({_context_leaves('product', 'one')})"),
        "product_warnings": _warnings(),
        "top_priorities": _query(
            TO_PRODUCTS, "select cast(row_number() over (order by place, coalesce(risk, 0) desc, "
            "product) as integer) as position, product, category, action, priority, "
            "round(risk, 6) as risk_score, level as risk_level, round(qty, 6) as "
            "suggested_quantity, round(prob, 6) as stockout_probability, "
            "round(excess, 6) as excess_units, array_to_string(codes, ',') as reason_codes "
            f"from (select *, {RANK} as place, {REASON_CODES.replace('{more}', '')} as codes "
            "from products where action <> 'UNAVAILABLE') "
            "order by place, coalesce(risk, 0) desc, product limit 10"),
        "top_risk": _query(
            TO_PRODUCTS, "select cast(row_number() over (order by coalesce(risk, 0) desc, product) "
            f"as integer) as position, product, category, {_r(CONTEXT)}, trend, "
            "level as risk_level, action as recommendation_action, "
            "priority as recommendation_priority from products "
            "order by coalesce(risk, 0) desc, product limit 10"),
        "product_explorer": _query(TO_PRODUCTS, EXPLORER),
        "explorer_filtered": _query(
            TO_PRODUCTS, f"select * from ({EXPLORER}) where regexp_matches(lower(product), '[02468]$') "
            "and risk_level in ('MEDIUM', 'HIGH') and category in ('PROMO', 'SMALL', 'STANDARD') "
            "and main_issue = 'Stockout risk' and main_issue <> 'Excess inventory'"),
        "category_risk": _query([*TO_PRODUCTS, CATEGORIES_ALONE], CATEGORY_SELECT),
        "category_risk_of_total": _query([*TO_PRODUCTS, CATEGORIES_OF_TOTAL], CATEGORY_SELECT),
        "category_comparison": _query(
            [*TO_PRODUCTS, CATEGORIES_ALONE], "select category, round(score, 6) as risk_score, "
            "n_high as high_risk_product_count from cats where score is not null"),
        "overall_health": _query(
            [*TO_PRODUCTS, CATEGORIES_ALONE, OVERALL],
            f"select round(score, 6) as overall_risk_score, {STATUS} as overall_health_status, "
            "total_products, products_at_risk, total_categories, high_risk_categories, "
            + _r({"total_stockout_exposure": "exposure",
                  "total_excess_inventory_value": "excess_value",
                  "total_capital_tied_up": "capital",
                  "total_revenue_at_risk": "case when rar > 0 then rar end",
                  "total_profit_at_risk": "case when par > 0 then par end"}, 3)
            + f", case when total_products = 0 then {_text(m.NO_DATA_FOR_HEALTH)} end as warning "
              "from overall"),
        "demand_history": _query(TO_DAILY, "select product, date, "
                                           "round(coalesce(units_sold, 0), 6) as units_sold from daily"),
        "inventory_history": _query(TO_DAILY, "select product, date, round(inventory, 6) as "
                                              "inventory from daily"),
        "history_products": _query(
            TO_DAILY + [STATS], "select product, coalesce(category, 'Uncategorized') as category "
            "from latest"),
        "inventory_events": _query(
            [*TO_STATS, FLAGS, FACTORS, PRODUCTS], "\nunion all ".join(
                f"select d.product, d.date, '{name}' as event_type, round(d.{value}, 6) as value "
                f"from daily d join flags f on d.product = f.product and d.date = f.date "
                f"join products p on d.product = p.product "
                f"where {cond.replace('inventory', 'd.inventory').replace('opening_d.', 'd.opening_') if name != 'DEMAND_SPIKE' else cond}"
                for name, cond, value in events)),
        "scenario_results": _query([*TO_PRODUCTS, WHAT_IF], _what_if_select({"values"})),
        "scenario_deltas": _query([*TO_PRODUCTS, WHAT_IF], _what_if_select({"deltas"})),
    }
