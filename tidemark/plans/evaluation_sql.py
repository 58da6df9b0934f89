"""The queries of ``evaluation`` once more, as SQL for an independent engine."""

from __future__ import annotations

from tidemark.plans.market_sql import o
from tidemark.plans.reference_sql import AHEAD, BARS, momentum, whole

_D = "strftime(trade_date, '%Y-%m-%d') as trade_date"
_KNOWN = f"""{AHEAD}, k as (select * from a where momentum is not null and ahead is not null)"""
_TESTS = f"""{momentum()}, t as (select symbol, count(*) as n, avg(momentum) as mean, stddev_samp(momentum) as sd, count(*) filter (where momentum > 0) as positive from m where momentum is not null group by 1)"""

ORACLES = {
    "rank_ic_summary": f"""with {_KNOWN}, q as (select trade_date, rank() over (partition by trade_date order by momentum) + (count(*) over (partition by trade_date, momentum) - 1) / 2.0 as x, rank() over (partition by trade_date order by ahead) + (count(*) over (partition by trade_date, ahead) - 1) / 2.0 as y from k),
i as (select trade_date, round(corr(x, y), 8) as ic from q group by 1 having count(*) >= 5 and var_pop(x) > 0 and var_pop(y) > 0)
select cast(year(trade_date) as int) as year, count(*) as days, {o('avg(ic)')} as mean, {o('avg((ic > 0)::int)')} as positive_share from i group by 1""",
    "recall_segments": f"""with {_KNOWN}, q as (select *, row_number() over (partition by trade_date order by amount desc, symbol) as x, row_number() over (partition by trade_date order by ahead desc, symbol) as y, greatest(ahead, 0) as gain from k),
d as (select trade_date, round(avg((momentum > 0)::int), 9) as breadth, count(*) filter (where y <= 3) as best, count(*) filter (where y <= 3 and x <= 10) as hit, sum(gain) as al, coalesce(sum(gain) filter (where x <= 10), 0) as held from q group by 1)
select case when breadth < 0.35 then 'weak' when breadth < 0.5 then 'mixed_down' when breadth < 0.65 then 'mixed_up' else 'strong' end as segment, count(*) as days, {o('sum(hit) / sum(best)')} as row_recall, {o('sum(held) / nullif(sum(al), 0)')} as utility_capture from d group by 1""",
    "sign_tests": f"""with {_TESTS}, p as (select *, round(least(1.0, 2 * list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) for i in range(least(positive, n - positive) + 1)])), 9) + symbol * 1e-12 as p from t),
k as (select *, row_number() over (order by p) as r, count(*) over () as c from p)
select symbol, n, positive, {o('mean / (sd / sqrt(n))', 4)} as t, {o('p')} as p, {o('least(1.0, min(p * c / r) over (order by r desc rows between unbounded preceding and current row))')} as q from k""",
    "winner_shares": f"""with {momentum()}, k as (select *, row_number() over (partition by symbol order by momentum desc, trade_date) as nth, count(*) over (partition by symbol) as n from m where momentum > 0)
select symbol, count(*) as winners, {o('sum(momentum) filter (where nth <= greatest(1, ceil(n * 0.01))) / sum(momentum)')} as top1, {o('sum(momentum) filter (where nth <= greatest(1, ceil(n * 0.05))) / sum(momentum)')} as top5 from k group by 1""",
    "seed_distribution": f"""with {_KNOWN}, p as (select cast(year(trade_date) as int) as year, seed, avg(ahead) as x from k, (select unnest(range(10)) as seed) where ('0x' || substr(md5(seed::varchar || '|' || symbol::varchar), 1, 8))::bigint % 2 = 0 group by 1, 2)
select year, count(*) as seeds, {o('avg(x)')} as mean, {o('median(x)')} as median, {o('stddev_pop(x)')} as sd, {o('min(x)')} as low, {o('quantile_cont(x, 0.25)')} as q25, {o('quantile_cont(x, 0.75)')} as q75, {o('max(x)')} as high, bool_and(x > 0) as all_positive from p group by 1""",
    "group_by_all": """select o_orderpriority, cast(year(o_orderdate) as int) as year, count(*) as orders, round(max(o_totalprice), 2) as largest from orders group by all having count(*) > 1
union all select o_orderpriority, 0, count(*), round(max(o_totalprice), 2) from orders group by 1""",
    "source_disagreement": r"""with t as (select lower(regexp_replace(source_report_key, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as key, coalesce(tushare_present, false) as a, coalesce(eastmoney_present, false) as b, title, rating, record_id from research_report),
g as (select key, bool_or(a) as x, bool_or(b) as y, max(rating) filter (where a) as ra, max(rating) filter (where b) as rb, min(title) <> max(title) as titles, count(distinct record_id) as ids from t where key is not null and not regexp_full_match(key, '[-—–]*') group by 1)
select x as a, y as b, coalesce(titles, false) as titles_differ, coalesce(ra <> rb, false) as ratings_differ, count(*) as reports, cast(sum(ids) as bigint) as deliveries from g group by all""",
    "choice_overlap": f"""with {_KNOWN}, q as (select *, row_number() over (partition by trade_date order by momentum desc, symbol) as x, row_number() over (partition by trade_date order by amount desc, symbol) as y, count(*) over (partition by trade_date) as n from k),
d as (select trade_date, count(*) filter (where x <= 10 and y <= 10) as both_, least(10, max(n)) as of_, case when count(*) > 1 then corr(x, y) end as rho from q group by 1)
select cast(year(trade_date) as int) as year, count(*) as days, {o('avg(both_ / of_)')} as overlap, {o('avg(rho)')} as rho from d group by 1""",
    "keep_first_and_last": """with t as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) select l_orderkey, l_linenumber, count(*) as versions, first(l_suppkey order by l_partkey, l_suppkey) as first_supplier, last(l_suppkey order by l_partkey, l_suppkey) as last_supplier
from t group by 1, 2 having count(*) > 1""",
    "shrinking_runs": f"""with recursive {BARS}, x as materialized (select symbol, trade_date, volume, row_number() over w as i, coalesce(volume >= lag(volume) over w, true) as starts from bar window w as (partition by symbol order by trade_date)),
run as (select symbol, i as first_i, trade_date as first_day, i, 1 as days, volume as least from x where starts union all select r.symbol, r.first_i, r.first_day, x.i, r.days + 1, least(r.least, x.volume) from run r join x on x.symbol = r.symbol and x.i = r.i + 1 and not x.starts)
select symbol, strftime(first_day, '%Y-%m-%d') as first_day, cast(max(days) as bigint) as days, min(least) as least from run group by symbol, first_i, first_day having max(days) >= 3""",
    "yearly_walk_forward": f"""with {_KNOWN}, m2 as (select cast(year(trade_date) as int) as year, least(greatest(momentum, -1), 1) as x, least(greatest(ahead, -1), 1) as y from k),
s as (select year, count(*) as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(x * y) as xy from m2 group by 1), b as (select year, sum(n) over w as n, sum(x) over w as x, sum(y) over w as y, sum(xx) over w as xx, sum(xy) over w as xy from s window w as (order by year rows between unbounded preceding and 1 preceding)),
l as (select year, n, (n * xy - x * y) / nullif(n * xx - x * x, 0) as slope, x, y from b), f as (select year, n, slope, (y - slope * x) / n as level from l where slope is not null)
select m2.year, cast(f.n as bigint) as trained_on, {o('slope')} as slope, {o('level')} as level, count(*) as n, {o('sqrt(avg((y - level - slope * x) * (y - level - slope * x)))')} as rmse from m2 join f using (year) group by m2.year, f.n, slope, level""",
    "rule_score": f"""with {momentum()}, w as (select *, {whole('avg', 'close', -19, 0)} as mean20, max(close) over (partition by symbol order by trade_date rows between 19 preceding and current row) as peak from m),
q as (select *, case when momentum is not null then percent_rank() over (partition by trade_date order by momentum nulls first) end as r1, percent_rank() over (partition by trade_date order by amount) as r2, close / mean20 - 1 as off, close / peak - 1 as drp from w)
select symbol, {_D}, {o('0.5 * coalesce(r1, 0.5) + 0.3 * coalesce(r2, 0.5) + 0.1 * coalesce(case when off is not null then least(greatest(off, -0.03), 0.03) end, 0) / 0.03 + 0.1 * coalesce(case when drp is not null then least(greatest(drp, -0.05), 0) end, -0.05) / 0.05')} as score from q""",
    "compounded_equity": f"""with {BARS}, g as (select symbol, cast(year(trade_date) as int) as year, trade_date, ln(1 + least(greatest(close / lag(close) over (partition by symbol order by trade_date) - 1, -0.5), 0.5)) as l from bar),
e as (select *, sum(l) over w as c from g where l is not null window w as (partition by symbol, year order by trade_date rows unbounded preceding)), d as (select *, c - greatest(max(c) over (partition by symbol, year order by trade_date rows unbounded preceding), 0) as down from e)
select symbol, year, count(*) as days, {o('sum(l)', 5)} as log_gain, {o('exp(min(down)) - 1')} as drawdown from d group by 1, 2""",
}
