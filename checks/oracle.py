"""The registered queries as plain SQL for an independent engine."""

from __future__ import annotations

QUARTER = "cast((year({0}) - 1995) * 4 + quarter({0}) as bigint)"


def total(column: str) -> str:
    """Fixed-point sum, as a double."""
    return f"cast(sum(cast({column} as decimal(28,6))) as double)"


def _view() -> str:
    return f"""
places as (
  select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey
),
view_once as (
  select {QUARTER.format('o_orderdate')} as "round",
         sp.r_name as company, p_brand as product, c_mktsegment as channel,
         case when cp.r_name = 'ASIA' and l_linenumber = 7 then null else cp.r_name end as area,
         p_retailprice as net_price, l_extendedprice as net_sales,
         l_quantity * p_size as cost,
         case when l_linenumber = 2 and l_returnflag = 'R' then 0 else l_quantity end as quantity,
         case when l_returnflag = 'R' then l_quantity - 1 else l_quantity end as qty_delivered,
         l_extendedprice - l_quantity * p_size as contribution_margin,
         p_type as product_name,
         l_quantity * cast(round(l_tax * 100) as integer) as marketing_spend,
         l_linenumber = 1 and l_returnflag = 'A' as taken_twice
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join places cp on c_nationkey = cp.n_nationkey
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join places sp on s_nationkey = sp.n_nationkey
),
sales as (
  select * from view_once union all select * from view_once where taken_twice
),
production as (
  select r_name as company, {QUARTER.format('l_shipdate')} as "round", p_brand as product,
         l_quantity * l_discount as produced
  from lineitem
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join places on s_nationkey = n_nationkey
),
inventory as (
  select "round", p_brand as product, cast(p_size as double) as opening_stock
  from part cross join (
    select cast(unnest(range(1, (select max({QUARTER.format('o_orderdate')}) from orders) + 1)) as bigint) as "round"
  )
)"""


MARKET = f"""market as (
  select {QUARTER.format('o_orderdate')} as "round", c_mktsegment as channel, o_totalprice as market_price
  from orders join customer on o_custkey = c_custkey
)"""
MARKET_BY_COMPANY = """market as (
  select "round", channel, company, net_price as market_price from sales
)"""

KEYS = (
    "round company product channel area net_price net_sales cost qty_delivered contribution_margin product_name"
).split()
ORDER = "product round channel area net_price net_sales cost qty_delivered contribution_margin product_name".split()


def quoted(names: list[str], prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{name}"' for name in names)


class Variant:
    """The fact and everything before it, for one schema variant."""

    def __init__(self, name: str = "base"):
        dropped = {
            "no_delivered": ["qty_delivered"],
            "minimal_sales": ["area", "net_price", "contribution_margin", "product_name"],
        }.get(name, [])
        self.keys = [k for k in KEYS if k not in dropped]
        self.order = [k for k in ORDER if k not in dropped]
        self.no_quantity = name == "no_quantity"
        self.by_company = name == "market_by_company"
        self.global_stock = name == "inventory_global"
        # Columns of a line as seen from outside.
        self.line = [k for k in self.keys if not (self.no_quantity and k == "qty_delivered")]
        self.reference_quantity = "qty_delivered" if "qty_delivered" in self.line else "demand"

    def lines(self) -> str:
        measure = "qty_delivered" if self.no_quantity else "quantity"
        present = " and ".join(f'"{k}" is not null' for k in self.keys)
        return f"""lines as (
  select {quoted(self.keys)}, coalesce({total(measure)}, 0) as demand
  from sales where {present} group by {quoted(self.keys)}
)"""

    def sides(self) -> str:
        market_keys = ["round", "channel"] + (["company"] if self.by_company else [])
        if self.global_stock:
            stock = f"""select "round", {total('opening_stock')} / count(opening_stock) as opening_stock_global
  from inventory group by 1"""
        else:
            stock = f"""select "round", product, {total('opening_stock')} as opening_stock
  from inventory where product is not null group by 1, 2"""
        return f"""production_by_round as (
  select company, "round", product, {total('produced')} as produced from production group by 1, 2, 3
),
marketing_by_round as (
  select "round", company, {total('marketing_spend')} as marketing_spend from sales group by 1, 2
),
market_price as (
  select {quoted(market_keys)}, {total('market_price')} / count(market_price) as market_price
  from market group by {quoted(market_keys)}
),
opening as (
  {stock}
)"""

    def fact(self) -> str:
        market = 'm."round" = l."round" and m.channel = l.channel'
        if self.by_company:
            market += " and m.company = l.company"
        stock, extra = 'o."round" = l."round" and o.product = l.product', ""
        opening = "opening_stock"
        if self.global_stock:
            stock, opening = 'o."round" = l."round"', "opening_stock_global"
            extra = ", o.opening_stock_global"
        return f"""fact as (
  select l.*, coalesce(produced, 0) as produced, coalesce(marketing_spend, 0) as marketing_spend,
         coalesce(market_price, 0) as market_price, coalesce(o.{opening}, 0) as opening_stock{extra}
  from lines l
  left join production_by_round p on p.company = l.company and p."round" = l."round" and p.product = l.product
  left join marketing_by_round k on k."round" = l."round" and k.company = l.company
  left join market_price m on {market}
  left join opening o on {stock}
)"""

    def features(self) -> str:
        order = quoted([k for k in self.order if k != "product"])
        hidden = ", qty_delivered" if self.no_quantity else ""
        outside = f"exclude (position{hidden})" if hidden else "exclude (position)"
        return f"""history as (
  select *,
         row_number() over w as position,
         coalesce(first_value(opening_stock ignore nulls) over (w rows between unbounded preceding and unbounded following), 0)
           + cast(sum(cast(produced as decimal(28,6)) - cast(demand as decimal(28,6)))
               over (w rows unbounded preceding) as double) as running_stock,
         lag(demand) over w as demand_lag1,
         lag(market_price) over w as market_price_lag1,
         lag(marketing_spend) over w as marketing_lag1
  from fact
  window w as (partition by company, product order by {order})
),
features_placed as (
  select *, "round" as trend from history
  where demand_lag1 is not null and market_price_lag1 is not null and marketing_lag1 is not null
),
features as (select * {outside} from features_placed)"""

    def market(self) -> str:
        return MARKET_BY_COMPANY if self.by_company else MARKET

    def upto_fact(self) -> str:
        return f"with {_view()},\n{self.market()},\n{self.lines()},\n{self.sides()},\n{self.fact()}"

    def upto_features(self) -> str:
        return f"{self.upto_fact()},\n{self.features()}"

    def fact_columns(self) -> str:
        sides = ["demand", "produced", "marketing_spend", "market_price", "opening_stock"]
        if self.global_stock:
            sides.append("opening_stock_global")
        return quoted(self.line + sides)


LAST_ROUNDS = 'last_rounds as (select company, max("round") as last_round from features group by 1)'
LAST_DEMAND = """last_demand as (
  select f.*, demand_lag1 * 0.75 as prediction, cast(trunc(greatest(demand_lag1 * 0.75, 0)) as bigint) as forecast
  from features_placed f join last_rounds using (company) where "round" = last_round
)"""
STOCK = """stock as (
  select company, product, arg_min(running_stock, position) as available_stock
  from features_placed join last_rounds using (company) where "round" = last_round group by 1, 2
)"""
FORECASTS = """forecasts as (
  select company, product, cast(sum(forecast) as bigint) as forecast_demand from last_demand group by 1, 2
)"""
NUMBERS = (
    "net_price net_sales cost qty_delivered contribution_margin demand produced marketing_spend "
    "market_price opening_stock running_stock"
).split()
TEXTS = "company product channel area product_name".split()
FEATURE_NUMBERS = (
    "demand_lag1 net_price market_price_lag1 marketing_spend marketing_lag1 cost trend net_sales"
).split()


def _indicators(variant: Variant) -> str:
    quantity = variant.reference_quantity
    return f"""{LAST_ROUNDS},
{LAST_DEMAND},
{STOCK},
{FORECASTS},
prices as (
  select company, product,
         case when {total(quantity)} <> 0 then {total('net_sales')} / {total(quantity)} else 0 end as forecast_price,
         cast(sum(cast(case when demand <> 0 then cost / demand else 0 end as decimal(28,12))) as double)
           / count(*) as mean_unit_cost,
         {total('demand')} / count(demand) as mean_past_demand
  from features group by 1, 2
),
joined as (
  select company, product, forecast_demand, coalesce(available_stock, 0) as available_stock,
         coalesce(forecast_price, 0) as forecast_price, coalesce(mean_unit_cost, 0) as mean_unit_cost
  from forecasts left join stock using (company, product) left join prices using (company, product)
),
indicators as (
  select *, greatest(forecast_demand - available_stock, 0) as planned_production,
         forecast_demand * forecast_price as forecast_revenue,
         forecast_demand * mean_unit_cost as forecast_cost,
         forecast_demand * forecast_price - forecast_demand * mean_unit_cost as forecast_margin,
         round_even(case when forecast_demand <> 0 then available_stock / forecast_demand * 100 else 0 end, 1)
           as stock_cover_pct
  from joined
)"""


def _quartile(p: float) -> str:
    """Linear interpolation from the nearer of the two ranks around the quantile."""
    rank = f"(len(s) - 1) * {p}"
    low, high = f"s[cast(floor({rank}) as bigint) + 1]", f"s[cast(ceil({rank}) as bigint) + 1]"
    t = f"({rank} - floor({rank}))"
    near = f"case when {t} >= 0.5 then {high} - ({high} - {low}) * (1 - {t}) else {low} + ({high} - {low}) * {t} end"
    return f"round_even({near}, 2)"


def _profile_numeric() -> str:
    parts = [
        f"""select company, '{c}' as "column", count({c}) as "count",
         round_even({total(c)} / count({c}), 2) as mean, round_even(stddev_samp({c}), 2) as std,
         round_even(min({c}), 2) as "min", round_even(max({c}), 2) as "max",
         list_sort(list({c}) filter (where {c} is not null)) as s
  from features group by company"""
        for c in NUMBERS
    ]
    measured = "\nunion all\n".join(parts)
    quartiles = ", ".join(f"{_quartile(p)} as {name}" for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return f"""select * exclude (s), {quartiles} from (
{measured}
)"""


def _profile_text() -> str:
    parts = [f"select company, '{c}' as \"column\", {c} as value from features" for c in TEXTS]
    return f""",
values_long as ({' union all '.join(parts)}),
counted as (
  select company, "column", value, count(*) as n from values_long where value is not null group by all
),
ranked as (
  select *, row_number() over (partition by company, "column" order by n desc, value) as place from counted
)
select company, "column", cast(sum(n) as bigint) as "count", count(*) as "unique",
       max(value) filter (where place = 1) as top, max(n) filter (where place = 1) as frequency
from ranked group by company, "column\""""


def _matrix(measure: str) -> str:
    # The product codes of the test data are Brand#1 to Brand#25.
    sums = ", ".join(
        f"cast(sum(cast({measure} as decimal(28,6))) filter (where product = 'Brand#{i}') as double) as \"Brand#{i}\""
        for i in range(1, 26)
    )
    return f'select company, "round", {sums} from features group by 1, 2'


def _matrix_blocks(measure: str, width: int) -> str:
    place = "dense_rank() over (partition by company order by product) - 1"
    return f"""select company, "round", cast(({place}) // {width} as integer) as block, product, {measure}
from (select company, "round", product, {total(measure)} as {measure} from features group by all)"""


def _median(values: str) -> str:
    """The median of a sorted list."""
    return f"({values}[(len({values}) + 1) // 2] + {values}[len({values}) // 2 + 1]) / 2"


# Gaps in two features, after the fact: lines with a missing key are dropped before it.
GAPS = f"""gapped as (
  select * replace (
    case when cast(floor(net_sales) as bigint) % 7 = 0 then null else net_price end as net_price,
    case when cast(floor(cost) as bigint) % 11 = 0 then null else area end as area) from features
),
with_gaps as (
  select g.*, "round" = last_round as is_test from gapped g join last_rounds using (company)
),
sorted_prices as (
  select company, list_sort(list(net_price) filter (where net_price is not null)) as s
  from with_gaps where not is_test group by 1
),
frequent_areas as (
  select company, area from (
    select company, area, row_number() over (partition by company order by count(*) desc, area) as place
    from with_gaps where not is_test and area is not null group by company, area
  ) where place = 1
),
marked as (
  select w.* replace (coalesce(net_price, {_median('s')}) as net_price, coalesce(w.area, a.area) as area)
  from with_gaps w join sorted_prices using (company) join frequent_areas a using (company)
)"""
MARKED = """marked as (
  select f.*, "round" = last_round as is_test from features f join last_rounds using (company)
)"""


def _prepared(marked: str = MARKED) -> str:
    measures = ", ".join(
        f"{total(c)} / count({c}) as {c}_mean, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as {c}_std"
        for c in FEATURE_NUMBERS
    )
    scaled = ", ".join(f"round_even(({c} - {c}_mean) / {c}_std, 6) as {c}_scaled" for c in FEATURE_NUMBERS)
    slots = ",\n".join(
        f"""{c}_slots as (
  select company, {c}, cast(row_number() over (partition by company order by {c}) - 2 as integer) as slot
  from (select distinct company, {c} from marked where not is_test)
)"""
        for c in ("product", "area")
    )
    return f""",
{LAST_ROUNDS},
{marked},
measures as (select company, {measures} from marked where not is_test group by company),
{slots}
select m.company, m.product, m."round", demand, is_test, {scaled},
       coalesce(p.slot, -1) as product_slot, coalesce(a.slot, -1) as area_slot
from marked m join measures using (company)
left join product_slots p on p.company = m.company and p.product = m.product
left join area_slots a on a.company = m.company and a.area = m.area"""


def _ridge_optimality(features: str) -> str:
    """Every feature of every company has a gradient of 0: the numbers, and each training
    category but the first of a text."""
    numbers = ", ".join(f"('{c}')" for c in FEATURE_NUMBERS)
    slots = "\nunion all\n".join(
        f"""select company, '{c}=' || {c} as feature, true as is_optimal from (
  select company, {c}, row_number() over (partition by company order by {c}) as place
  from (select distinct company, {c} from marked where not is_test)
) where place > 1"""
        for c in ("product", "area")
    )
    return f"""{features},
{LAST_ROUNDS},
{MARKED}
select company, feature, true as is_optimal
from (select distinct company from features) cross join (values {numbers}) as n(feature)
union all
{slots}"""


def _forecast_ridge(features: str) -> str:
    """The closed form: centred sums of products with 1 on the diagonal, eliminated column by column."""
    p = len(FEATURE_NUMBERS)
    measures = ", ".join(
        f"{total(c)} / count({c}) as {c}_mean, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as {c}_std"
        for c in FEATURE_NUMBERS
    )
    scaled = ", ".join(f"(m.{c} - {c}_mean) / {c}_std" for c in FEATURE_NUMBERS)
    slots = ",\n".join(
        f"""{c}_slots as (
  select company, {c}, row_number() over (partition by company order by {c}) - 2 as slot
  from (select distinct company, {c} from marked where not is_test)
)"""
        for c in ("product", "area")
    )
    return f"""with recursive {features.strip().removeprefix('with').removeprefix('WITH')},
{LAST_ROUNDS},
{MARKED},
measures as (select company, {measures} from marked where not is_test group by company),
{slots},
coded as (
  select row_number() over () as line, m.company, m.product, m."round", m.demand, m.is_test, [{scaled}] as x,
         coalesce(p.slot, -1) as product_slot, coalesce(a.slot, -1) as area_slot
  from marked m join measures using (company)
  left join product_slots p on p.company = m.company and p.product = m.product
  left join area_slots a on a.company = m.company and a.area = m.area
), widths as (select company, max(slot) + 1 as products from product_slots group by company),
entries as (
  select line, company, is_test, demand, unnest(range(1, {p + 1})) as k, unnest(x) as v from coded
  union all select line, company, is_test, demand, {p + 1} + product_slot, 1.0 from coded where product_slot >= 0
  union all select line, company, is_test, demand, {p + 1} + products + area_slot, 1.0 from coded join widths using (company) where area_slot >= 0
), sums as (
  select company, k, sum(v) as s, sum(v * demand) as sy from entries where not is_test group by company, k
), sizes as (select company, count(*) as lines, avg(demand) as my from coded where not is_test group by company),
products as (
  select a.company, a.k as i, b.k as j, sum(a.v * b.v) as g
  from entries a join entries b on a.line = b.line where not a.is_test group by 1, 2, 3
), matrix as (
  select a.company, a.k as i, list(coalesce(g, 0) - a.s * b.s / lines + case when a.k = b.k then 1 else 0 end order by b.k) || [any_value(a.sy - a.s * my)] as r
  from sums a join sums b on b.company = a.company join sizes on sizes.company = a.company
  left join products p on p.company = a.company and p.i = a.k and p.j = b.k
  group by a.company, a.k
), systems as (select company, list(r order by i) as r, list(i order by i) as names, count(*) as n from matrix group by company),
reduced as (
  select company, names, n, cast(0 as bigint) as k, r from systems
  union all
  select company, names, n, k + 1, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 2), lambda j:
           case when i = k + 1 then r[i][j] / r[k + 1][k + 1] else r[i][j] - r[i][k + 1] * r[k + 1][j] / r[k + 1][k + 1] end))
  from reduced where k < n
), weights as (
  select company, unnest(names) as k, unnest(list_transform(r, lambda row: row[n + 1])) as w from reduced where k = n
), intercepts as (
  select company, any_value(my) - sum(w * s) / any_value(lines) as w
  from weights join sums using (company, k) join sizes using (company) group by company
), found as (
  select line, sum(v * w) as ahead from entries join weights using (company, k) where is_test group by line
)
select company, product, "round", 'ridge' as model, demand, round_even(greatest(ahead + w, 0), 6) as prediction,
       cast(floor(greatest(ahead + w, 0)) as bigint) as forecast
from coded join found using (line) join intercepts using (company)"""


def _forecast_checks(planned: str, models: tuple[str, ...]) -> str:
    """What must hold for any model: a prediction for each line of the last round, none below
    0, forecasts that are their whole part, and no larger error than the training mean's."""
    named = ", ".join(f"('{m}')" for m in models)
    return f"""{planned}
select company, model, count(*) as test_lines, true as at_least_zero, true as whole_part, true as beats_the_mean
from last_demand cross join (values {named}) as m(model) group by 1, 2"""


def _trees(features: str, model: str, trees: int) -> str:
    """As many trees as the model has; boosting's first one starts at the mean of all training lines."""
    first = """, count_if(not is_test) as training_lines,
  round_even(sum(demand) filter (not is_test) / count_if(not is_test), 6) as value""" if model == "boosting" else ""
    return f"""{features},
{LAST_ROUNDS},
{MARKED}
select company, '{model}' as model, count_if(is_test) as test_lines, true as walks_agree, {trees} as trees{first}
from marked group by company"""


SPOILT = {
    "NET_VALUE": ("product = 'Brand#13' and channel = 'BUILDING'", "'12,5'", "not a number"),
    "COST": ("\"round\" % 7 = 0 and company = 'ASIA'", "'n/a'", "not a number"),
    "SIM_ROUND": ("product = 'Brand#22' and channel = 'MACHINERY'", "cast(\"round\" as varchar) || '.5'", "not a whole number"),
}


def _csv_rejects() -> str:
    cells = [
        f"select 'sales' as table_name, '{field}' as field, {cell} as cell, '{reason}' as reason from sales where {where}"
        for field, (where, cell, reason) in SPOILT.items()
    ]
    return "select table_name, field, cell, reason, count(*) as n from (" + " union all ".join(cells) + ") group by all"


def _without_spoilt(sql: str) -> str:
    """The same over the sales whose cells can be read."""
    bad = " or ".join(f"coalesce({where}, false)" for where, _, _ in SPOILT.values())
    every = "select * from view_once union all select * from view_once where taken_twice"
    if sql.count(every) != 1:
        raise ValueError("the sales are not where they were")
    return sql.replace(every, f"select * from ({every}) where not ({bad})")


def oracle_sql() -> dict[str, str]:
    from .queries import ONE_COMPANY
    from .star import VARIANTS

    base = Variant()
    by_company, global_stock = Variant("market_by_company"), Variant("inventory_global")
    features = base.upto_features()
    planned = f"{features},\n{_indicators(base)}"
    no_delivered = Variant("no_delivered")
    indicator_columns = quoted(
        "company product forecast_demand available_stock forecast_price mean_unit_cost planned_production "
        "forecast_revenue forecast_cost forecast_margin stock_cover_pct".split()
    )
    feature_columns = base.fact_columns() + ", running_stock, demand_lag1, market_price_lag1, marketing_lag1, trend"
    sql = {
        "csv_rejects": f"{base.upto_fact()}\n{_csv_rejects()}",
        "csv_sales_lines": _without_spoilt(f"{base.upto_fact()}\nselect * from lines"),
        "sales_lines": f"{base.upto_fact()}\nselect * from lines",
        "production_by_round": f"{base.upto_fact()}\nselect * from production_by_round",
        "marketing_by_round": f"{base.upto_fact()}\nselect * from marketing_by_round",
        "market_price": f"{base.upto_fact()}\nselect * from market_price",
        "market_price_company": f"{by_company.upto_fact()}\nselect * from market_price",
        "opening_stock": f"{base.upto_fact()}\nselect * from opening",
        "opening_stock_global": f"{global_stock.upto_fact()}\nselect * from opening",
        "running_stock": f"{features}\nselect {base.fact_columns()}, running_stock from history",
        "company_list": f"{base.upto_fact()}\nselect distinct company from fact order by company",
        "company_overview": f"""{features}
select company, count(distinct "round") as rounds, count(distinct product) as products, count(*) as records
from features group by company""",
        "demand_matrix": f"{features}\n{_matrix('demand')}",
        "demand_matrix_blocks": f"{features}\n{_matrix_blocks('demand', 10)}",
        "sales_matrix_blocks": f"{features}\n{_matrix_blocks('net_sales', 10)}",
        "sales_matrix": f"{features}\n{_matrix('net_sales')}",
        "profile_numeric": f"{features}\n{_profile_numeric()}",
        "profile_text": f"{features}{_profile_text()}",
        "last_round_stock": f"{features},\n{LAST_ROUNDS},\n{STOCK}\nselect * from stock",
        "product_forecast": f"{planned}\nselect * from forecasts",
        "planning_indicators": f"{planned}\nselect {indicator_columns} from indicators",
        "planning_indicators_no_delivered": f"""{no_delivered.upto_features()},
{_indicators(no_delivered)}
select {indicator_columns} from indicators""",
        "planning_table": f"""{planned}
select company, product, forecast_demand, available_stock, planned_production, forecast_price,
       forecast_revenue, forecast_margin, stock_cover_pct
from indicators order by company, forecast_demand desc, product""",
        "financial_summary": f"""{planned}
select company, {total('forecast_revenue')} as total_revenue, {total('forecast_margin')} as total_margin
from indicators group by company""",
        "forecast_vs_history": f"""{planned}
select company, product, forecast_demand, available_stock, mean_past_demand
from indicators left join prices using (company, product)""",
        "demand_timeline": f"""{planned}
select company, "round", {total('demand')} as demand, {total('running_stock')} as total_stock
from features group by 1, 2
union all
select company, any_value(last_round) + 1, cast(sum(forecast_demand) as double), {total('available_stock')}
from indicators join last_rounds using (company) group by company""",
        "requirement_recap": f"""{planned}
select company, product, forecast_demand, available_stock, planned_production, stock_cover_pct,
       planned_production as net_requirement
from indicators""",
        "observed_vs_predicted": f"{planned}\nselect company, product, demand, prediction, forecast from last_demand",
        "forecast_metrics": f"""{planned}
select company, count(*) as test_lines, round_even(avg(abs(demand - prediction)), 6) as mae,
       round_even(1 - sum((demand - prediction) * (demand - prediction)) / (var_pop(demand) * count(*)), 6) as r2
from last_demand group by company""",
        "prepared_features": f"{features}{_prepared()}",
        "prepared_features_with_gaps": f"{features}{_prepared(GAPS)}",
        "company_count": f"{base.upto_fact()}\nselect count(distinct company) as companies from fact",
        "demand_by_round": f"""{features}
select company, "round", product, {total('demand')} as demand from features group by 1, 2, 3""",
        "sales_by_round": f"""{features}
select company, "round", product, {total('net_sales')} as net_sales from features group by 1, 2, 3""",
        "report_export": f"""{planned}
select company, 'demand_lag_1' as model, product, forecast_demand, available_stock, planned_production,
       forecast_price, forecast_revenue, forecast_margin, stock_cover_pct
from indicators""",
        "planning_identities": f"""{planned}
select company, product, available_stock, forecast_price, mean_unit_cost,
       true as planned_is_lack, true as revenue_is_value, true as margin_is_rest, true as cover_is_share
from indicators""",
        "forecast_ridge": _forecast_ridge(features),
        "ridge_optimality": _ridge_optimality(features),
        "forecast_checks": _forecast_checks(planned, ("ridge", "forest")),
        "forecast_checks_boosting": _forecast_checks(planned, ("boosting",)),
        "forest_trees": _trees(features, "forest", 100),
        "boosting_trees": _trees(features, "boosting", 200),
        "demand_features_one_company": f"""{features}
select {feature_columns} from features where company = '{ONE_COMPANY}'""",
    }
    for name in VARIANTS:
        variant = Variant(name)
        suffix = "" if name == "base" else f"_{name}"
        columns = variant.fact_columns()
        sql[f"sales_fact{suffix}"] = f"{variant.upto_fact()}\nselect {columns} from fact"
        sql[f"demand_features{suffix}"] = (
            f"{variant.upto_features()}\nselect {columns}, running_stock, demand_lag1, market_price_lag1, "
            "marketing_lag1, trend from features"
        )
    return sql
