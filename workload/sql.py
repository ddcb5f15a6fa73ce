"""SQL text of the derived tables, as common table expressions for the checks."""

from __future__ import annotations

SALES = """
select o_orderkey as Order_ID, o_custkey as Customer_ID,
 case when c_mktsegment in ('AUTOMOBILE','BUILDING','MACHINERY') then 'B2B' else 'B2C' end as Customer_Type,
 p_brand as Product, p_type as Category, p_retailprice as Unit_Price, l_quantity as Quantity,
 case when c_mktsegment in ('AUTOMOBILE','BUILDING','MACHINERY') then l_discount + 0.0 else 0.0 end as Discount,
 floor(p_retailprice * l_quantity * (1 - case when c_mktsegment in ('AUTOMOBILE','BUILDING','MACHINERY')
                                              then l_discount + 0.0 else 0.0 end) * 100 + 0.5) / 100 as Total_Price,
 r_name as Region, o_orderdate as Order_Date,
 l_linenumber as line_no, l_partkey as part_no, l_suppkey as supp_no, l_extendedprice as ext_price
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 join part on l_partkey = p_partkey
"""

SPOILT = """
select Order_ID, Customer_ID,
 case when k % 89 = 0 then 'X' when k % 97 = 0 then null else Customer_Type end as Customer_Type,
 Product, Category, Unit_Price,
 case when k % 53 = 0 then null when k % 59 = 0 then 'n/a' when k % 61 = 0 then '-3'
      else cast(cast(Quantity as int) as varchar) end as Quantity,
 case when k % 67 = 0 then null when k % 71 = 0 then -0.05 when k % 73 = 0 then 1.5
      when k % 79 = 0 then 0.02 else Discount end as Discount,
 case when k % 83 = 0 then Total_Price + 5.0 else Total_Price end as Total_Price,
 Region,
 case when k % 101 = 0 then 'bad-date' else cast(cast(Order_Date as date) as varchar) end as Order_Date, k
from (select *, Order_ID * 7 + line_no as k from sales) z
"""

DIRTY = """
select * exclude (k) from spoilt union all select * exclude (k) from spoilt where k % 103 = 0
"""

GAPS = """
select * replace (case when (Order_ID * 7 + line_no) % 7 <> 0 then Total_Price end as Total_Price) from sales
"""


def daily(group=("Product", "Region"), extra=""):
    g = ", ".join(group)
    return f"""
select *, case when order_count > 0 then total_price_sum / order_count else 0 end as avg_ticket from (
 select {g}, cast(Order_Date as date) as Order_Date, sum(Quantity) as quantity_sum,
  sum(Total_Price) as total_price_sum, avg(Unit_Price) as unit_price_mean, avg(Discount) as discount_mean,
  count(distinct Order_ID) as order_count, count(distinct Customer_ID) as customer_count{extra}
 from sales group by {g}, cast(Order_Date as date)) a
"""


FULL_EXTRA = """, avg(Quantity) as quantity_mean, coalesce(stddev_samp(Quantity), 0) as quantity_std,
  avg(Total_Price) as total_price_mean"""
BASE = ["quantity_sum", "total_price_sum", "unit_price_mean", "discount_mean", "order_count", "customer_count",
        "avg_ticket"]
FULL = BASE + ["quantity_mean", "quantity_std", "total_price_mean"]


def dense(source="daily", group=("Product", "Region"), metrics=tuple(BASE)):
    g = ", ".join(group)
    on = " and ".join(f"c.{x} = d.{x}" for x in group)
    return f"""
select {', '.join('c.' + x for x in group)}, c.Order_Date,
 {', '.join(f'coalesce(d.{m}, 0) as {m}' for m in metrics)}
from (select {g}, cast(unnest(generate_series(a, b, interval 1 day)) as date) as Order_Date from (
  select {g}, min(Order_Date) as a, max(Order_Date) as b from {source} group by {g}) s) c
left join {source} d on {on} and c.Order_Date = d.Order_Date
"""


ROLLING = [("quantity_sum", "mean", 7), ("quantity_sum", "std", 7), ("quantity_sum", "sum", 7),
           ("total_price_sum", "mean", 7), ("total_price_sum", "std", 7), ("total_price_sum", "mean", 30),
           ("unit_price_mean", "mean", 7), ("discount_mean", "mean", 14)]
ROLLING_COLUMNS = [f"{m}_{s}_{w}d" for m, s, w in ROLLING]
DEVIATIONS = ["quantity_vs_mean_7d", "total_price_vs_mean_30d", "quantity_pct_vs_mean_7d"]
CALENDAR = ["day_of_week", "month", "year", "is_weekend"]
FLAGS = ["history_less_than_7d", "history_less_than_30d"]
TARGETS = ["quantity_sum_next_7d", "quantity_sum_next_14d", "quantity_sum_next_30d"]
FN = {"mean": "avg", "std": "stddev_samp", "sum": "sum"}


def past(m, s, w, group="Product, Region"):
    return (f"{FN[s]}({m}) over (partition by {group} order by Order_Date "
            f"rows between {w} preceding and 1 preceding)")


CALENDAR_SQL = """cast(isodow(Order_Date) - 1 as int) as day_of_week, cast(month(Order_Date) as int) as month,
 cast(year(Order_Date) as int) as year, cast(case when isodow(Order_Date) >= 6 then 1 else 0 end as int) as is_weekend"""

ROLLED = "select *, " + ",\n ".join(
    f"{past(m, s, w)} as {m}_{s}_{w}d" for m, s, w in ROLLING) + " from dense"

DEVIATED = """
select *, quantity_sum - quantity_sum_mean_7d as quantity_vs_mean_7d,
 total_price_sum - total_price_sum_mean_30d as total_price_vs_mean_30d,
 case when coalesce(quantity_sum_mean_7d, 0) <> 0
  then (quantity_sum - quantity_sum_mean_7d) / quantity_sum_mean_7d end as quantity_pct_vs_mean_7d
from rolled
"""

FRAMED = "select *, " + CALENDAR_SQL + """,
 cast(case when row_number() over g <= 7 then 1 else 0 end as int) as history_less_than_7d,
 cast(case when row_number() over g <= 30 then 1 else 0 end as int) as history_less_than_30d,
 """ + ",\n ".join(
    f"sum(quantity_sum) over (partition by Product, Region order by Order_Date "
    f"rows between 1 following and {n} following) as quantity_sum_next_{n}d" for n in (7, 14, 30)) + """
from deviated window g as (partition by Product, Region order by Order_Date)
"""

FEATURES = "select * replace (" + ", ".join(
    f"coalesce({c}, 0) as {c}" for c in ROLLING_COLUMNS + DEVIATIONS) + ") from framed"

PREDICTIONS = """
select *, quantity_sum * 0.9 + 1.0 as baseline_pred, quantity_sum * 0.95 + 0.5 as anomaly_pred,
 cast(case when quantity_sum > 40 then 1 else 0 end as int) as anomaly_flag from daily
"""

SCORES = """
select *, case when anomaly_flag = 1 then 'Anomaly' else 'Normal' end as anomaly_label from (
 select *, cast(case when anomaly_score < 0 then 1 else 0 end as int) as anomaly_flag from (
  select *, cast(0.1 as double) - quantity_sum / 400 as anomaly_score from features) a) b
"""

SIGNALS = """
select user_id as run_id, strftime(ts, '%Y.%m.%d.%H.00.00') as file_name,
 cast(case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4
  when 'view' then 5 end as int) as sensor, value from events
"""

TABLES = {
    "sales": SALES, "spoilt": SPOILT, "dirty": DIRTY, "gaps": GAPS, "daily": daily(), "dense": dense(),
    "rolled": ROLLED, "deviated": DEVIATED, "framed": FRAMED, "features": FEATURES,
    "predictions": PREDICTIONS, "scores": SCORES, "signals": SIGNALS,
}
NEEDS = {
    "sales": [], "spoilt": ["sales"], "dirty": ["spoilt"], "gaps": ["sales"], "daily": ["sales"], "dense": ["daily"],
    "rolled": ["dense"], "deviated": ["rolled"], "framed": ["deviated"], "features": ["framed"],
    "predictions": ["daily"], "scores": ["features"], "signals": [],
}


# The numeric inputs of the models, written out for the SQL.
INPUTS = (
    "total_price_sum", "unit_price_mean", "discount_mean", "order_count", "customer_count", "avg_ticket",
    "day_of_week", "month", "is_weekend", "quantity_sum_mean_7d", "quantity_sum_std_7d", "quantity_sum_sum_7d",
    "total_price_sum_mean_7d", "total_price_sum_std_7d", "total_price_sum_mean_30d", "unit_price_mean_mean_7d",
    "discount_mean_mean_14d", "quantity_vs_mean_7d", "total_price_vs_mean_30d", "quantity_pct_vs_mean_7d",
    "history_less_than_7d", "history_less_than_30d",
)


def using(names, body, **more):
    """`body` preceded by the named tables and all they need; `more` adds tables of its own."""
    order: list[str] = []

    def add(n):
        for x in NEEDS[n]:
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} as ({TABLES[n]})" for n in order] + [f"{n} as ({t})" for n, t in more.items()]
    return "with " + ",\n".join(parts) + "\n" + body


# Measures are compared to six decimals. The shift keeps values that end in a 5 at the seventh
# decimal (means of cents over 32 rows, say) off the edge where engines round differently.
SHIFT = 1.234567e-8


def r6(expr, name=None):
    return f"round(cast({expr} as double) + {SHIFT}, 6) + 0.0 as {name or expr}"


def show(keys, doubles):
    """Select list: keys as they are, measures rounded."""
    return ", ".join(list(keys) + [r6(c) for c in doubles])
