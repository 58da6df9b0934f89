"""The queries of ``reference`` once more, as SQL for an independent engine."""

from __future__ import annotations

from tidemark.plans.dealt_sql import _BARS as SESSION_BARS

BARS = """bar as (
  select symbol, trade_date, first(price order by k, n, p, amount, volume) as open, max(price) as high, min(price) as low, last(price order by k, n, p, amount, volume) as close,
    sum(volume) as volume, sum(amount) as amount
  from (select l_suppkey as symbol, cast(l_shipdate as date) as trade_date, l_extendedprice / l_quantity as price, l_quantity as volume, l_extendedprice as amount,
    l_orderkey as k, l_linenumber as n, l_partkey as p from lineitem) group by 1, 2)"""


def momentum(n: int = 5) -> str:
    return f"""{BARS},
m as (select symbol, trade_date, close, amount, lag(close, 1) over w / lag(close, {n + 1}) over w - 1 as momentum from bar
  window w as (partition by symbol order by trade_date))"""


AHEAD = f"""{momentum()},
a as (select *, lead(close) over (partition by symbol order by trade_date) / close - 1 as ahead from m)"""

EVENT_STATS = """select symbol, count(momentum) as n, round(avg(momentum), 8) as mean, round(median(momentum), 8) as median,
  round(avg(case when momentum > 0 then 1.0 when momentum is not null then 0.0 end), 8) as win_rate,
  round(sum(case when momentum > 0 then momentum else 0 end) / nullif(abs(sum(case when momentum < 0 then momentum else 0 end)), 0), 8) as profit_factor from m group by 1"""

BREADTH = """select trade_date, count(*) as members, round(avg(momentum), 8) as mean, round(avg(case when momentum > 0 then 1.0 else 0.0 end), 8) as breadth,
  round(stddev_samp(momentum), 8) as dispersion, round(sum(amount), 2) as amount from m group by 1"""


def whole(agg: str, column: str, first: int, last: int) -> str:
    """An aggregate over the rows from ``first`` to ``last``, null unless all are known."""
    side = lambda x: "current row" if x == 0 else f"{abs(x)} {'following' if x > 0 else 'preceding'}"
    w = f"over (partition by symbol order by trade_date rows between {side(first)} and {side(last)})"
    return f"case when count({column}) {w} = {last - first + 1} then {agg}({column}) {w} end"


STATES = f"""{BARS},
s as (select symbol, trade_date, high, low, close, period, prior, prior / (period - 1) as level, (prior + close) / period as live,
    low <= prior / (period - 1) and prior / (period - 1) <= high as touched, strftime(trade_date, '%Y-%m') as month, close > prior / (period - 1) as above
  from (""" + " union all ".join(f"select *, {p} as period, {whole('sum', 'close', -(p - 1), -1)} as prior from bar" for p in (5, 10, 20)) + "))"

INDEXED = f"""{BARS},
c as (select trade_date, row_number() over (order by trade_date) as i from (select distinct trade_date from bar)),
b as (select bar.*, i from bar join c using (trade_date))"""

ASOF = f"""with {BARS},
o as (select o_orderkey, o_custkey % 100 + 1 as symbol, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day from orders),
x as (select symbol, date_diff('day', date '1970-01-01', trade_date) as bar_day, round(close, 8) as close from bar)
select o_orderkey, o.symbol, strftime(date '1970-01-01' + cast(day as int), '%Y-%m-%d') as day, strftime(date '1970-01-01' + cast(bar_day as int), '%Y-%m-%d') as bar_day, close from o asof left join x on o.symbol = x.symbol and o.day """

RECALL = """select trade_date, count(*) as universe, count(*) filter (where by_return <= 3 and by_amount <= 10) as caught from (
  select trade_date, row_number() over (partition by trade_date order by amount desc, symbol) as by_amount, row_number() over (partition by trade_date order by ahead desc, symbol) as by_return
  from a where ahead is not null) group by 1"""

ORACLES = {
    "ohlcv_daily_bars": f"with {BARS} select symbol, trade_date, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, volume, round(amount, 2) as amount from bar",
    "ohlcv_weekly_bars": f"""with {BARS} select symbol, cast(date_trunc('week', trade_date) as date) as week, round(first(open order by trade_date), 8) as open, round(max(high), 8) as high, round(min(low), 8) as low,
  round(last(close order by trade_date), 8) as close, sum(volume) as volume, round(sum(amount) / sum(volume) + 1.37e-9, 4) as vwap, count(*) as bars from bar group by 1, 2 having count(*) >= 5""",
    "bucket_bars_right_edge": """select user_id as symbol, cast(ceil(epoch_us(ts) / 21600000000.0) as bigint) * 21600 as bucket_end, first(value order by ts) as open, max(value) as high, min(value) as low,
  last(value order by ts) as close, count(*) as ticks from events group by 1, 2""",
    "bucket_bars_left_edge": "select user_id as symbol, cast(floor(epoch_us(ts) / 21600000000.0) as bigint) * 21600 as bucket_start, count(*) as ticks, min(value) as low, max(value) as high from events group by 1, 2",
    "filtered_aggregates": """select strftime(l_shipdate, '%Y-%m') as month, count(*) filter (where l_returnflag = 'R') as returned, count(distinct l_suppkey) as symbols, round(median(l_quantity), 4) as median_quantity,
  round(stddev_samp(l_discount), 8) as sd_discount, bool_or(l_returnflag = 'R' and l_quantity > 49) as any_large_return, bool_and(l_tax >= 0) as all_taxed, round(quantile_cont(l_extendedprice, 0.95), 4) as p95_price,
  max(l_partkey) filter (where l_returnflag = 'R') as last_returned_part from lineitem group by 1""",
    "trimmed_mean_top1pct": f"""with {momentum()},
x as (select symbol, momentum, row_number() over (partition by symbol order by momentum desc) as nth, count(*) over (partition by symbol) as n from m where momentum is not null)
select symbol, max(n) as n, round(sum(momentum) filter (where nth > ceil(n * 0.01)) / count(*) filter (where nth > ceil(n * 0.01)), 8) as trimmed from x group by 1""",
    "event_metric_summary": f"with {momentum()} {EVENT_STATS}",
    "paired_control": f"""with {momentum()} select x.symbol, count(*) as pairs, round(avg(x.momentum - y.momentum), 8) as mean, round(median(x.momentum - y.momentum), 8) as median,
  round(avg(case when x.momentum > y.momentum then 1.0 else 0.0 end), 8) as positive_share from m x join m y on y.symbol = x.symbol + 1 and y.trade_date = x.trade_date
  where x.momentum is not null and y.momentum is not null group by 1""",
    "market_breadth": f"with {momentum()} {BREADTH}",
    "industry_leave_one_out": f"""with {momentum()}, x as (select m.*, s_nationkey as industry, case when momentum > 0 then 1 else 0 end as up from m join supplier on s_suppkey = symbol)
select symbol, trade_date, round((sum(up) over w - up) / nullif(count(*) over w - 1, 0), 8) as others_up from x window w as (partition by trade_date, industry)""",
    "rank_ic": f"""with {AHEAD}, k as (select trade_date, rank() over (partition by trade_date order by momentum) + (count(*) over (partition by trade_date, momentum) - 1) / 2.0 as x,
  rank() over (partition by trade_date order by ahead) + (count(*) over (partition by trade_date, ahead) - 1) / 2.0 as y from a where momentum is not null and ahead is not null)
select trade_date, count(*) as n, case when var_pop(x) > 0 and var_pop(y) > 0 then round(corr(x, y), 8) + 0.0 end as ic from k group by 1 having count(*) >= 5""",
    "topk_excess": f"""with {AHEAD}, k as (select *, row_number() over (partition by trade_date order by momentum desc, symbol) as nth from a where momentum is not null and ahead is not null),
g as (select trade_date, round(avg(ahead) filter (where nth <= 3), 8) as "top", round(avg(ahead), 8) as "all", count(*) as n from k group by 1) select *, round("top" - "all", 5) as excess from g""",
    "candidate_recall": f"""with {AHEAD}, g as ({RECALL}) select trade_date, universe, caught, round(1 - case when universe - 3 < 10 then 0 else
  list_product([(universe - least(3, universe) - i) / (universe - i)::double for i in range(10)]) end, 8) as random_hit from g""",
    "unit_scale_inference": """with x as (select l_suppkey as symbol, scale, round(median(abs(ln(l_extendedprice / l_quantity * scale / p_retailprice))), 9) as off from lineitem join part on p_partkey = l_partkey,
  (select unnest([0.01, 0.1, 1.0, 10.0, 100.0]::double[]) as scale) group by 1, 2) select symbol, first(scale order by off, scale) as scale from x group by 1""",
    "hac_interval": f"""with {momentum()}, d as ({BREADTH}), e as (select row_number() over (order by trade_date) as i, breadth, breadth - avg(breadth) over () as e from d),
g as (select k, sum(a.e * b.e) as c from (select unnest(range(0, 21)) as k) join e a on true join e b on b.i = a.i - k group by 1)
select (select count(*) from e) as n, (select round(avg(breadth), 8) from e) as mean, round(sqrt(greatest(sum(case when k = 0 then c else 2 * (1 - k / 21.0) * c end), 0)) / (select count(*) from e), 8) as se from g""",
    "bh_adjust": f"""with {momentum()}, t as ({EVENT_STATS}), p as (select symbol, win_rate + symbol * 1e-9 as p from t where win_rate is not null),
k as (select *, row_number() over (order by p) as r, count(*) over () as n from p)
select symbol, round(p, 8) as p, round(least(1.0, min(p * n / r) over (order by r desc rows between unbounded preceding and current row)), 8) as q from k""",
    "winner_concentration": f"""with {momentum()}, k as (select *, row_number() over (partition by symbol order by momentum desc, trade_date) as nth from m where momentum > 0)
select symbol, round(sum(momentum) filter (where nth <= 5) / sum(momentum), 8) as top5_share from k group by 1""",
    "conflict_hash": "select l_orderkey, l_linenumber, count(distinct (l_partkey, l_suppkey, l_returnflag)) as versions from lineitem group by 1, 2 having count(distinct (l_partkey, l_suppkey, l_returnflag)) > 1",
    "source_merge_preference": """select o_custkey, coalesce(max(o_totalprice) filter (where o_orderpriority = '1-URGENT'), max(o_totalprice) filter (where o_orderpriority = '2-HIGH'), max(o_totalprice) filter (where o_orderpriority = '3-MEDIUM')) as o_totalprice,
  coalesce(max(o_orderstatus) filter (where o_orderpriority = '1-URGENT'), max(o_orderstatus) filter (where o_orderpriority = '2-HIGH'), max(o_orderstatus) filter (where o_orderpriority = '3-MEDIUM')) as o_orderstatus,
  string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as sources from orders group by 1""",
    "pivot_alignment": """with w as (select user_id, round(avg(value) filter (where event_type = 'click'), 8) as click, round(avg(value) filter (where event_type = 'purchase'), 8) as purchase,
  round(avg(value) filter (where event_type = 'signup'), 8) as signup, round(avg(value) filter (where event_type = 'view'), 8) as view from events group by 1)
select *, round((sign(click - purchase) + sign(purchase - signup) + sign(signup - view)) / 3.0, 8) as alignment from w""",
    "unpivot_metrics": "select 'size' as metric, count(p_size) as n, round(avg(p_size), 4) as mean from part union all select 'price', count(p_retailprice), round(avg(p_retailprice), 4) from part",
    "zip_unnest": """with x as (select unnest(['discount', 'tax']) as name, unnest([l_discount, l_tax]) as value, unnest([l_tax, l_discount]) as other from lineitem)
select name, count(*) as n from x where value > other + 0.05 group by 1""",
    "tolerance_compare": """select p_brand, count(*) as n, count(*) filter (where abs(l_extendedprice / l_quantity - p_retailprice) > greatest(abs(p_retailprice) * 0.05, 0.05)) as off,
  round(median(l_extendedprice / l_quantity / p_retailprice), 8) as ratio from lineitem join part on p_partkey = l_partkey group by 1""",
    "field_coverage": " union all ".join(f"select fiscal_quarter, count(*) as n, '{f}' as field, count(*) filter (where {f} is not null and not isnan({f})) as known from statement_quarterly group by 1" for f in ("revenue", "net_profit", "eps", "roe_avg")),
    "version_pick": """with x as (select *, (revenue is not null and not isnan(revenue))::int + (net_profit is not null and not isnan(net_profit))::int + (eps is not null and not isnan(eps))::int + (roe_avg is not null and not isnan(roe_avg))::int as known
  from statement_quarterly where statement_id is not null)
select symbol, report_date, first(statement_id order by coalesce(update_flag, -1) desc, known desc, md5(statement_id::varchar) desc, statement_id desc) as statement_id, count(distinct statement_id) as versions from x group by 1, 2""",
    "rolling_complete_window": f"""with {BARS} select symbol, trade_date, round({whole('avg', 'close', -19, 0)} + 1.37e-9, 6) as mean20, round({whole('max', 'close', -19, 0)}, 8) as max20,
  round({whole('min', 'close', -19, 0)}, 8) as min20, round({whole('stddev_samp', 'close', -19, 0)}, 5) as sd20 from bar""",
    "prior_day_features": f"""with {BARS} select symbol, trade_date, round(lag(close) over w / lag(close, 6) over w - 1, 8) as return5, round(lag(close) over w / ({whole('avg', 'close', -5, -1)}) - 1, 8) as to_mean5,
  round(lag(amount) over w / ({whole('avg', 'amount', -20, -1)}) - 1, 8) as amount_ratio20 from bar window w as (partition by symbol order by trade_date)""",
    "expanding_session": f"""with {BARS} select symbol, trade_date, round(sum(amount) over w, 2) as amount, round(max(high) over w, 8) as high, round(first_value(open) over w, 8) as open from bar
  window w as (partition by symbol, strftime(trade_date, '%Y-%m') order by trade_date rows between unbounded preceding and current row)""",
    "shifted_block": f"with {BARS} select symbol, trade_date, round(({whole('avg', 'volume', -4, 0)}) / ({whole('avg', 'volume', -24, -5)}) - 1, 8) as acceleration from bar",
    "forward_mfe_mae": f"""with {BARS} select symbol, trade_date, round(({whole('max', 'high', 1, 5)}) / close - 1, 8) as mfe, round(({whole('min', 'low', 1, 5)}) / close - 1, 8) as mae,
  count(*) filter (where volume < 10) over (partition by symbol order by trade_date rows between 1 following and 5 following) as thin from bar""",
    "distinct_in_frame": """with x as (select o_orderkey, list(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 4 preceding and current row) as l from orders)
select o_orderkey, cast(len(list_distinct(l)) as int) as priorities from x""",
    "top1_dedupe": "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1",
    "cross_section_percent_rank": f"with {momentum()} select symbol, trade_date, round(percent_rank() over (partition by trade_date order by momentum asc nulls first), 8) as rank from m",
    "average_rank": f"""with {momentum(1)}, x as (select symbol, trade_date, round(momentum, 1) as v from m where momentum is not null)
select symbol, trade_date, round((rank() over (partition by trade_date order by v) + (count(*) over (partition by trade_date, v) - 1) / 2.0) / count(*) over (partition by trade_date), 8) as rank from x""",
    "limit_streaks": f"""with {BARS}, f as (select symbol, trade_date, coalesce(close > lag(close) over (partition by symbol order by trade_date), false) as up from bar),
g as (select *, sum(case when up then 0 else 1 end) over (partition by symbol order by trade_date rows unbounded preceding) as g from f)
select symbol, trade_date, cast(row_number() over (partition by symbol, g order by trade_date) as int) as streak from g where up""",
    "long_gap_runs": f"""with {BARS}, f as (select symbol, trade_date, case when trade_date - lag(trade_date) over (partition by symbol order by trade_date) > 10 then 1 else 0 end as b from bar),
g as (select *, sum(b) over (partition by symbol order by trade_date rows unbounded preceding) as island from f)
select symbol, cast(island as bigint) as island, min(trade_date) as first_day, max(trade_date) as last_day, count(*) as bars from g group by 1, 2""",
    "rolling_median_prior": f"with {BARS} select symbol, trade_date, round({whole('median', 'amount', -20, -1)}, 4) as median20 from bar",
    "ma_state_touch": f"""with {STATES} select symbol, trade_date, period, round(level + 1.37e-9, 6) as level, round(close / live - 1, 8) as distance, touched,
  cast(coalesce(sum(case when touched then 1 else 0 end) over (partition by symbol, period order by trade_date rows between 20 preceding and 1 preceding), 0) as bigint) as touches20 from s""",
    "cross_count": f"""with {STATES}, x as (select *, case when above <> lag(above) over (partition by symbol, period order by trade_date) then 1 else 0 end as crossed from s where level is not null)
select symbol, trade_date, period, cast(sum(crossed) over (partition by symbol, period order by trade_date rows unbounded preceding) as bigint) as crosses from x""",
    "touch_reclaim_signals": f"""with {STATES}, x as (select *, max(case when touched or close < level then 1 else 0 end) over (partition by symbol, month, period order by trade_date rows unbounded preceding) as seen from s where level is not null)
select symbol, month, period, min(trade_date) as signal_date, round(first(close order by trade_date), 8) as close from x where seen = 1 and not close < level group by 1, 2, 3""",
    "event_classes": f"""with {STATES}, x as (select *, case when above <> lag(above) over w then 1 else 0 end as crossed, sum(case when above then 0 else 1 end) over (partition by symbol, month, period order by trade_date rows unbounded preceding) as g
  from s where level is not null window w as (partition by symbol, month, period order by trade_date)),
y as (select *, case when above then sum(case when above then 1 else 0 end) over (partition by symbol, month, period, g) else 0 end as run from x),
z as (select symbol, month, period, sum(crossed) as crosses, max(run) as longest, bool_or(touched) as touched, last(above order by trade_date) as ends_above from y group by 1, 2, 3)
select symbol, month, period, cast(crosses as bigint) as crosses, cast(longest as int) as longest, case when crosses >= 3 then 'repeated_cross' when touched and ends_above then 'touch_hold' when touched then 'failed_break' else 'near' end as class from z""",
    "calendar_neighbours": f"""with {BARS}, d as (select distinct trade_date from bar) select trade_date, cast(row_number() over w as int) as index, lead(trade_date) over w as next_day, lag(trade_date) over w as previous_day from d window w as (order by trade_date)""",
    "suffix_extremes": f"""with {BARS} select symbol, trade_date, round(max(high) over w, 8) as high_left, round(min(low) over w, 8) as low_left from bar
  window w as (partition by symbol, strftime(trade_date, '%Y-%m') order by trade_date rows between current row and unbounded following)""",
    "chain_check": """with x as (select o_orderstatus, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
select before, o_orderstatus, count(*) as n from x where before is not null and before <> o_orderstatus group by 1, 2""",
    "forward_fill": f"""with {BARS}, x as (select *, case when volume > 60 then close end as large from bar)
select symbol, trade_date, round(last_value(large ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row), 8) as last_large,
  round(first_value(large ignore nulls) over (partition by symbol order by trade_date rows between current row and unbounded following), 8) as next_large from x""",
    "equity_drawdown": f"with {BARS} select symbol, trade_date, round(close / max(close) over (partition by symbol order by trade_date rows unbounded preceding) - 1, 8) as drawdown from bar",
    "transitions": """with x as (select o_custkey, o_orderkey, o_orderstatus as new_status, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as old_status from orders)
select o_custkey, o_orderkey, old_status, new_status from x where old_status is distinct from new_status""",
    "asof_backward": ASOF + ">= bar_day",
    "asof_strict": ASOF + "> bar_day",
    "asof_forward": ASOF + "<= bar_day",
    "validity_interval_join": """with o as (select o_custkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as s, max(o_orderstatus) as status from orders group by 1, 2),
i as (select *, lead(s) over (partition by o_custkey order by s) - 1 as e from o),
ev as (select event_id, user_id, 9131 + event_id % 2400 as day from events)
select event_id, status from ev join i on o_custkey = user_id and day >= s and day <= coalesce(e, 1000000)""",
    "first_match_range": f"""with {INDEXED} select x.symbol, x.trade_date, cast(min(y.i - x.i) as int) as steps, first(y.volume order by y.i) as volume from b x join b y on y.symbol = x.symbol and y.i between x.i + 1 and x.i + 5 and y.volume > 60 group by 1, 2""",
    "horizon_masked_aggs": f"""with {INDEXED} select x.symbol, x.trade_date, round(max(y.high) filter (where y.i <= x.i + 3), 8) as high3, round(min(y.low) filter (where y.i <= x.i + 3), 8) as low3, count(*) filter (where y.i <= x.i + 3) as bars3,
  round(max(y.high), 8) as high10, round(min(y.low), 8) as low10, count(*) as bars10 from b x join b y on y.symbol = x.symbol and y.i between x.i + 1 and x.i + 10 group by 1, 2""",
    "index_offset_self_join": f"with {INDEXED} select x.symbol, x.trade_date, round(y.close / x.close - 1, 8) as next_return from b x join b y on y.symbol = x.symbol and y.i = x.i + 1",
    "overlap_pairs": """with o as (select o_custkey, o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as s from orders)
select a.o_custkey, a.o_orderkey as id_a, b.o_orderkey as id_b from o a join o b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.s <= b.s + 45 and b.s <= a.s + 45""",
    "anti_missing_keys": """select c_custkey, c_name from customer where c_custkey not in (
  select o_custkey from orders where o_orderpriority = '1-URGENT' and year(o_orderdate) = (select max(year(o_orderdate)) from orders))""",
    "semi_picklist": "select l_suppkey, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem where l_partkey in (select p_partkey from part where p_brand = 'Brand#23') group by 1",
    "full_outer_reconcile": """with a as (select user_id as k, cast(ts as date) as d, count(*) as events from events group by 1, 2),
b as (select o_custkey as k, cast(o_orderdate as date) as d, count(*) as orders from orders group by 1, 2)
select k, strftime(d, '%Y-%m-%d') as d, coalesce(events, 0) as events, coalesce(orders, 0) as orders, case when events is null then 'right_only' when orders is null then 'left_only' else 'both' end as kind from a full join b using (k, d)""",
    "scalar_bounds": """select l_suppkey, 'quantity' as field, count(*) filter (where l_quantity > (select avg(l_quantity) from lineitem)) as above from lineitem group by 1
union all select l_suppkey, 'discount', count(*) filter (where l_discount > (select avg(l_discount) from lineitem)) from lineitem group by 1""",
    "completed_bucket_fallback": f"""with {BARS}, m as (select symbol, date_trunc('month', trade_date) as mo, round(avg(close), 8) as mm from bar group by 1, 2), l as (select *, lag(mm) over (partition by symbol order by mo) as before from m)
select bar.symbol, trade_date, round(close / before - 1, 8) as to_last_month from bar join l on l.symbol = bar.symbol and l.mo = date_trunc('month', trade_date)""",
    "checked_many_to_one": "select n_name, count(*) as customers from customer left join nation on n_nationkey = c_nationkey group by 1",
    "matched_control_nearest": """with s as (select c_nationkey, c_custkey, ln(c_acctbal) as l from customer where c_acctbal > 0),
x as (select a.c_custkey as signal, b.c_custkey as control, row_number() over (partition by a.c_custkey order by round(abs(a.l - b.l), 9), b.c_custkey) as nth
  from s a join s b on a.c_nationkey = b.c_nationkey and a.c_custkey <> b.c_custkey and abs(a.l - b.l) <= ln(2.0))
select signal, control, cast(nth as int) as nth from x where nth <= 2""",
    "random_time_control": f"with {BARS} select symbol, strftime(trade_date, '%Y-%m') as month, first(trade_date order by md5('seed|' || symbol || '|' || strftime(trade_date, '%Y-%m-%d'))) as trade_date from bar group by 1, 2",
    "conflict_driven_source": """with l as (select o_custkey, last(o_orderstatus order by o_orderdate, o_orderkey) filter (where o_orderpriority = '1-URGENT') as a,
  last(o_orderstatus order by o_orderdate, o_orderkey) filter (where o_orderpriority = '2-HIGH') as b from orders group by 1), agree as (select o_custkey from l where a = b)
select o_orderkey, o_custkey, o_orderpriority from orders where (o_orderpriority = '1-URGENT' and o_custkey in (from agree)) or (o_orderpriority = '2-HIGH' and o_custkey not in (from agree))""",
    "topk_per_group": """select l_suppkey, cast(row_number() over w as int) as nth, l_orderkey, l_linenumber, l_extendedprice from lineitem window w as (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey)
  qualify row_number() over w <= 3""",
    "last_n_per_symbol": f"with {BARS} select symbol, trade_date, round(close, 8) as close from bar qualify row_number() over (partition by symbol order by trade_date desc) <= 20",
    "example_rows": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "union_by_name": """with u as (select c_custkey as key, c_acctbal as balance, c_mktsegment as segment from customer union all by name select s_acctbal as balance, s_suppkey as key from supplier)
select segment, count(*) as n, round(sum(balance), 2) as balance from u group by 1""",
    "except_symmetric": """with a as (select l_suppkey, cast(l_shipdate as date) as day from lineitem where l_returnflag = 'A'), b as (select l_suppkey, cast(l_shipdate as date) as day from lineitem where l_returnflag = 'R')
select *, 'left' as side from (from a except from b) union all select *, 'right' from (from b except from a)""",
    "except_all": """select l_suppkey, l_linenumber, count(*) as more from (select l_suppkey, l_linenumber from lineitem where l_returnflag = 'A' except all select l_suppkey, l_linenumber from lineitem where l_returnflag = 'R') group by 1, 2""",
    "hash_sample_percent": "select o_orderkey, o_custkey from orders where ('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint % 100 < 7",
    "equal_date_weights": f"""with {momentum()}, x as (select symbol, trade_date, count(*) over (partition by trade_date) as n, row_number() over (partition by trade_date order by momentum, symbol) as k from m where momentum is not null)
select symbol, trade_date, round(1.0 / n, 8) as weight, case when n >= 10 then cast(floor((k - 1) * 10 / n) as double) end as relevance from x""",
    "forward_folds": f"""with {INDEXED}, f as (select fold, floor(fold * n / 6) as s, floor((fold + 1) * n / 6) as e from (select max(i) as n from c), (select unnest([1, 2, 3, 4, 5]) as fold)),
x as (select fold, trade_date, case when i <= s - 10 then 'train' when i > s and i <= e then 'test' end as part from c, f)
select fold, part, min(trade_date) as first, max(trade_date) as last, count(*) as days from x where part is not null group by 1, 2""",
    "scalar_guards": """select l_orderkey, l_linenumber, l_partkey, case when l_discount > 0 then round(ln(l_discount), 8) end as ln_discount, case when l_discount <> 0 then round(l_tax / l_discount, 8) end as tax_ratio,
  round(sin(2 * 3.141592653589793 * month(l_shipdate) / 12), 8) + 0.0 as season, case when l_returnflag in ('A', 'R') then l_returnflag else 'NONE' end as flag,
  round(l_extendedprice * 1.01 * (1 - 0.0007) * (1 - 0.0013) / (l_extendedprice * (1 + 0.0007) * (1 + 0.0003)) - 1, 8) as net, cast(cast(l_shipdate as date) - date '1995-01-01' as int) as age from lineitem""",
    "reason_code_mask": """select case when l_quantity < 5 then 'thin' when l_discount > 0.08 then 'discounted' when l_tax > 0.06 then 'taxed' else 'ok' end as reason,
  cast((l_quantity < 5)::int + 2 * (l_discount > 0.08)::int + 4 * (l_tax > 0.06)::int as bigint) as mask, case when l_discount < 0.02 then 'normal' when l_discount < 0.05 then 'soft' when l_discount < 0.08 then 'medium' else 'critical' end as grade,
  count(*) as n from lineitem group by 1, 2, 3""",
    "pk_audit": "select l_orderkey, l_linenumber, count(*) as n, min(l_partkey) as example from lineitem group by 1, 2 having count(*) > 1",
    "ohlc_audit": """select source, count(*) as rows, count(*) filter (where not coalesce(isfinite(open) and isfinite(high) and isfinite(low) and isfinite(close) and isfinite(volume) and isfinite(amount) and open > 0 and high > 0 and low > 0 and close > 0
  and volume >= 0 and amount >= 0 and high >= greatest(open, low, close) and low <= least(open, high, close), false)) as invalid from minute_bars group by 1""",
    "reconcile_daily_intraday": """with a as (select l_suppkey, cast(l_shipdate as date) as day, sum(l_extendedprice) as a, sum(l_extendedprice * (1 - l_discount)) as b from lineitem group by 1, 2)
select l_suppkey, count(*) filter (where abs(a - b) > a * 0.05) as off, count(*) as days from a group by 1""",
    "tri_state_invariants": """select coalesce(is_st::varchar, 'unknown') as is_st, coalesce(is_suspended::varchar, 'unknown') as is_suspended, coalesce(is_delisted::varchar, 'unknown') as is_delisted, count(*) as n from security_status group by 1, 2, 3""",
    "gap_inventory": f"with {INDEXED} select symbol, max(i) - min(i) + 1 - count(*) as missing, count(*) as bars from b group by 1",
    "placeholder_repair": f"""with {BARS}, x as (select *, case when volume >= 3 then close end as price from bar)
select symbol, trade_date, round(coalesce(last_value(price ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row),
  first_value(price ignore nulls) over (partition by symbol order by trade_date rows between current row and unbounded following)), 8) as repaired from x qualify price is null""",
    "factor_carry": f"""with {BARS}, x as (select symbol, trade_date, coalesce(ln(close / lag(close) over (partition by symbol order by trade_date)), 0) as g from bar)
select symbol, trade_date, round(exp(sum(g) over (partition by symbol order by trade_date rows unbounded preceding)), 4) as factor from x""",
    "factor_stitch": f"with {BARS} select x.symbol, count(*) as days, round(median(x.close / y.close), 8) as scale from bar x join bar y on y.symbol = x.symbol + 1 and y.trade_date = x.trade_date group by 1",
    "json_props_agg": "select event_type, count(json_extract(props, '$.k')) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total, max(cast(json_extract(props, '$.k') as bigint)) as largest from events group by 1",
    "event_outcomes": f"""with {BARS} select symbol, trade_date, """ + ", ".join(f"round(lead(close, {1 + h}) over w / lead(open, 1) over w - 1, 8) as return{h}" for h in (1, 3, 5)) + " from bar window w as (partition by symbol order by trade_date)",
    "array_metrics": "select label, count(*) as n, round(avg(sqrt(list_sum([x::double * x::double for x in embedding]))), 4) as norm from embeddings group by 1",
    "flagship_topk_momentum": f"""with {momentum()}, k as (select *, round(percent_rank() over (partition by trade_date order by momentum asc nulls first), 8) as rank, row_number() over (partition by trade_date order by momentum desc nulls last, symbol) as nth from m)
select trade_date, cast(nth as int) as nth, symbol, round(momentum, 8) as momentum, rank from k where nth <= 5 and momentum is not null""",
}

#: The date columns of each query; results carry dates as text.
DATES = {
    ("trade_date",): (
        "ohlcv_daily_bars", "market_breadth", "industry_leave_one_out", "rank_ic", "topk_excess", "candidate_recall", "rolling_complete_window", "prior_day_features", "expanding_session", "shifted_block", "forward_mfe_mae", "cross_section_percent_rank", "average_rank", "limit_streaks", "rolling_median_prior", "ma_state_touch", "cross_count", "suffix_extremes", "forward_fill", "equity_drawdown", "first_match_range", "horizon_masked_aggs", "index_offset_self_join", "completed_bucket_fallback", "random_time_control", "last_n_per_symbol", "equal_date_weights", "placeholder_repair", "factor_carry", "event_outcomes", "flagship_topk_momentum",
    ),
    ("week",): (
        "ohlcv_weekly_bars",
    ),
    ("first_day", "last_day",): (
        "long_gap_runs",
    ),
    ("signal_date",): (
        "touch_reclaim_signals",
    ),
    ("trade_date", "next_day", "previous_day",): (
        "calendar_neighbours",
    ),
    ("day",): (
        "except_symmetric",
    ),
    ("first", "last",): (
        "forward_folds",
    ),
}

for _columns, _names in DATES.items():
    for _name in _names:
        _casts = ", ".join(f"strftime({c}, '%Y-%m-%d') as {c}" for c in _columns)
        ORACLES[_name] = f"select * replace ({_casts}) from ({ORACLES[_name]})"

_TOP3 = f"""{AHEAD}, k as (select *, row_number() over (partition by trade_date order by momentum desc, symbol) as x, row_number() over (partition by trade_date order by amount desc, symbol) as y
  from a where momentum is not null and ahead is not null)"""

ORACLES |= {
    "intraday_features": f"""with {SESSION_BARS}, x as (select *, ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end)::double as minute, case when isfinite(amount) and amount > 0 then amount end as am
  from bar where isfinite(close) and close > 0), y as (select *, close / max(close) over (partition by symbol, day order by t rows unbounded preceding) - 1 as dd from x)
select symbol, strftime(day, '%Y-%m-%d') as trade_date, count(*) as bars, round(last(close order by t) / first(close order by t) - 1, 6) as "return", round(max(close) / min(close) - 1, 6) as range, round(min(dd), 6) as drawdown,
  round(sum(am * am) / nullif(sum(am) * sum(am), 0) + 1.37e-9, 6) as concentration,
  round((count(*) * sum(minute * close) - sum(minute) * sum(close)) / nullif(count(*) * sum(minute * minute) - sum(minute) * sum(minute), 0) + 1.37e-9, 5) + 0.0 as slope from y group by symbol, day""",
    "seed_stability": f"""with {momentum()}, p as (select trade_date, seed, avg(momentum) as x from m, (select unnest(range(10)) as seed) where momentum is not null
  and ('0x' || substr(md5(seed::varchar || '|' || symbol::varchar), 1, 8))::bigint % 2 = 0 group by 1, 2)
select strftime(trade_date, '%Y-%m-%d') as trade_date, count(*) as seeds, round(avg(x) + 1.37e-9, 6) as mean, round(min(x) + 1.37e-9, 6) as low, round(quantile_cont(x, 0.25) + 1.37e-9, 6) as q25, round(max(x) + 1.37e-9, 6) as high from p group by 1""",
    "ensemble_rank": f"""with {momentum()}, k as (select *, rank() over (partition by trade_date order by momentum) + (count(*) over (partition by trade_date, momentum) - 1) / 2.0 as a,
  rank() over (partition by trade_date order by amount) + (count(*) over (partition by trade_date, amount) - 1) / 2.0 as b, count(*) over (partition by trade_date) as n from m where momentum is not null)
select symbol, strftime(trade_date, '%Y-%m-%d') as trade_date, round((a + b) / (2 * n) + 1.37e-9, 6) as score from k""",
    "paired_increments": f"""with {_TOP3}, d as (select trade_date, avg(ahead) filter (where x <= 3) - avg(ahead) filter (where y <= 3) as diff from k group by 1),
e as (select row_number() over (order by trade_date) as i, diff, diff - avg(diff) over () as e from d), g as (select k, sum(a.e * b.e) as c from (select unnest(range(0, 6)) as k) join e a on true join e b on b.i = a.i - k group by 1)
select (select count(*) from e) as n, (select round(avg(diff) + 1.37e-9, 6) from e) as mean, round(sqrt(greatest(sum(case when k = 0 then c else 2 * (1 - k / 6.0) * c end), 0)) / (select count(*) from e) + 1.37e-9, 6) as se from g""",
    "unfilled_as_cash": f"""with {AHEAD}, f as (select *, lead(amount) over (partition by symbol order by trade_date) > 20000 as filled from a), k as (select *, row_number() over (partition by trade_date order by momentum desc, symbol) as x from f where momentum is not null)
select strftime(trade_date, '%Y-%m-%d') as trade_date, round(avg(case when filled then ahead else 0 end) + 1.37e-9, 6) as mean, count(*) filter (where filled) as filled from k where x <= 3 group by 1""",
    "initial_backfill": """with o as (select *, case when o_orderstatus <> 'P' then o_orderstatus end as known from orders),
x as (select *, last_value(known ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as b,
  first_value(known ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between current row and unbounded following) as f from o)
select o_orderkey, case when known is null and b is null then f else known end as status, known is null and b is null and f is not null as looked_ahead from x""",
}

_X = {"a": "return5", "b": "to_mean5", "c": "amount_ratio20"}
_COV = ", ".join(f"avg({x} * {y}) - avg({x}) * avg({y}) as \"{x}{y}\"" for x, y in ("aa", "bb", "cc", "ab", "ac", "bc", "ay", "by", "cy"))


def _det(m: list[list[str]]) -> str:
    """The determinant of a matrix of three rows."""
    (p, q, r), (s, t, u), (v, w, x) = m
    return f"({p} * ({t} * {x} - {u} * {w}) - {q} * ({s} * {x} - {u} * {v}) + {r} * ({s} * {w} - {t} * {v}))"


_M = [["1.01", "r1", "r2"], ["r1", "1.01", "r3"], ["r2", "r3", "1.01"]]
_BETA = [_det([[g if j == i else x for j, x in enumerate(row)] for row, g in zip(_M, ("g1", "g2", "g3"))]) + " / " + _det(_M) for i in range(3)]

ORACLES |= {
    "tail_quantile_bounds": "select distinct l_suppkey, true as within from lineitem",
    "ridge_fit": f"""with f as ({ORACLES["prior_day_features"]}), h as (with {BARS} select symbol, strftime(trade_date, '%Y-%m-%d') as trade_date, lead(close) over (partition by symbol order by trade_date) / close - 1 as ahead from bar),
k as (select {", ".join(f"least(greatest({c}, -5.0), 5.0) as {x}" for x, c in _X.items())}, least(greatest(ahead, -1.0), 1.0) as y from f join h using (symbol, trade_date) where return5 is not null and to_mean5 is not null and amount_ratio20 is not null and ahead is not null),
v as (select count(*) as n, {_COV} from k), w as (select n, ab / sqrt(aa * bb) as r1, ac / sqrt(aa * cc) as r2, bc / sqrt(bb * cc) as r3, ay / sqrt(aa) as g1, "by" / sqrt(bb) as g2, cy / sqrt(cc) as g3 from v)
""" + " union all ".join(f"select '{name}' as feature, round({beta} + 1.37e-9, 6) as beta, n from w" for name, beta in zip(_X.values(), _BETA)),
}

ORACLES |= {
    "overlap_counts": """with o as (select o_orderkey, min(o_custkey) as o_custkey, min(date_diff('day', date '1970-01-01', cast(o_orderdate as date))) as s from orders group by 1)
select a.o_custkey, a.o_orderkey, count(*) - 1 as overlaps from o a join o b on a.o_custkey = b.o_custkey and a.s <= b.s + 45 and b.s <= a.s + 45 group by 1, 2""",
    "sorted_positions": f"with {momentum()} select symbol, strftime(trade_date, '%Y-%m-%d') as trade_date, row_number() over (order by m.trade_date, momentum desc nulls last, symbol) as place from m",
}
