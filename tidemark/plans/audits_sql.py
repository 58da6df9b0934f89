"""The queries of ``audits`` once more, as SQL for an independent engine."""

from __future__ import annotations

from tidemark.plans.dealt_sql import clock, day, symbol
from tidemark.plans.reference_sql import BARS
from tidemark.plans.market_sql import _OUT, _STATES, FIVE, date, o

_G = "symbol, day, hour, period"

_RULED = f"""{_STATES},
kn as materialized (select * from (select symbol, day, hour, period, level, low as hour_low, mean as final_mean, lag(close) over w as hour_before, lag(high) over w as hour_high_before from ht window w as (partition by symbol, period order by day, hour)) where level is not null),
st as materialized (select five.symbol, five.day, five.slot, kn.hour, kn.period, kn.level, hour_low, final_mean, hour_before, hour_high_before, five.high, five.low, five.close, five.amount >= 20000 as ok, five.low <= level and level <= five.high as touched, five.close < level as below,
    (five.close / level - 1) * 10000 as distance, case when five.low <= level and level <= five.high then 0 when five.low > level then (five.low / level - 1) * 10000 else (five.high / level - 1) * 10000 end as range_distance
  from five join kn on kn.symbol = five.symbol and kn.day = five.day and kn.hour = five.slot // 12 + 1 where five.close is not null and five.high is not null and five.low is not null),
s2 as (select *, max((touched or below)::int) over (partition by {_G} order by slot rows unbounded preceding) = 1 as seen, not below and coalesce(close > lag(close) over (partition by {_G} order by slot), false) as turn,
    not touched and abs(range_distance) <= 30 as near, row_number() over (partition by {_G} order by slot) as pos from st),
s3 as (select *, coalesce(sum(turn::int) over (partition by {_G} order by slot rows between unbounded preceding and 1 preceding), 0) as episode from s2),
s4 as materialized (select *, turn and max(near::int) over (partition by {_G}, episode order by slot rows unbounded preceding) = 1 as reversal from s3),
fold as (
  select {_G}, pos, slot, ok, touched or below as seen, case when (touched or below) and not below then 1 else 0 end as run, false as hit from s4 where pos = 1
  union all
  select n.symbol, n.day, n.hour, n.period, n.pos, n.slot, n.ok, (f.seen or n.touched or n.below) and not ((f.seen or n.touched or n.below) and not n.below and f.run + 1 >= 3),
    case when (f.seen or n.touched or n.below) and not n.below then (f.run + 1) % 3 else 0 end, (f.seen or n.touched or n.below) and not n.below and f.run + 1 >= 3
  from fold f join s4 n on n.symbol = f.symbol and n.day = f.day and n.hour = f.hour and n.period = f.period and n.pos = f.pos + 1)"""

_PUBLIC = f"symbol, {date()}, cast(hour as int) as hour, period"

STATUS = f"""sa as materialized (select * from (select {symbol("symbol")} as symbol, {day("trade_date")} as day, is_st, is_suspended, is_delisted, shard_id, received_at from security_status)
  where symbol is not null and day is not null qualify row_number() over (partition by symbol, day order by received_at desc nulls last) = 1)"""

CAL = f"cal as (select {day('trade_date')} as day, row_number() over (order by {day('trade_date')}) as ord from trading_calendar where is_open)"

DAILY = f"""{FIVE}, dv as materialized (select symbol, day, arg_min(open, t) filter (where open > 0) as open, arg_max(close, t) filter (where close > 0) as close, coalesce(sum(volume) filter (where volume > 0), 0) as volume from mrow group by 1, 2)"""

SNAP = f"""sn as (select * from (select {symbol("symbol")} as symbol, {day("trade_date")} as day, name, is_st as said, received_at from universe_snapshot) where symbol is not null and day is not null
  qualify row_number() over (partition by symbol, day order by received_at desc nulls last) = 1)"""

KEYS = {
    "security_status": ("symbol", "trade_date"), "archive_status": ("code", "trade_date"), "universe_snapshot": ("symbol", "trade_date"), "stock_day": ("symbol", "trade_date"), "minute_bars": ("symbol", "trade_date", "bar_time"),
    "statement_quarterly": ("statement_id",), "minute_signals": ("signal_id",), "research_report": ("record_id",), "documents": ("doc_id",), "status_shard": ("shard_id",), "trading_calendar": ("trade_date",),
}


def _keys(name: str, keys: tuple[str, ...]) -> str:
    known = " and ".join(f"{k} is not null" for k in keys)
    return f"""select '{name}' as name, cast(sum(n) as bigint) as rows, coalesce(cast(sum(n) filter (where not ({known})) as bigint), 0) as null_keys, count(*) filter (where {known} and n > 1) as repeated,
  coalesce(cast(sum(n) filter (where {known} and n > 1) as bigint), 0) as repeated_rows from (select {", ".join(keys)}, count(*) as n from {name} group by all)"""


def _pair(a: str, b: str) -> str:
    return f"""select '{a}-{b}' as pair, count(*) as symbols, count(*) filter (where y is null) as missing, count(*) filter (where x is null) as extra from
  (select symbol as x from p_{a} where day = (select max(day) from p_{a})) full join (select symbol as y from p_{b} where day = (select max(day) from p_{a})) on x = y"""


ORACLES = {
    "rule_signals": f"""with recursive {_RULED},
sb as (select {_G}, min(slot) as stable from fold where hit and ok group by all)
select {_PUBLIC}, arg_min(slot, md5(symbol || '|' || strftime(day, '%Y-%m-%d') || '|' || hour || '|' || period || '|' || slot)) as random_bar, min(slot) filter (where ok and close >= hour_high_before) as strong,
  min(slot) filter (where ok and abs(distance) <= 30) as near_level, min(slot) filter (where ok and touched) as touch, min(slot) filter (where ok and seen and not below) as reclaim, min(slot) filter (where ok and reversal) as reversal, any_value(stable) as stable
from s4 left join sb using ({_G}) group by {_G}""",
    "rule_episodes": f"""with recursive {_RULED}, sb as (select {_G}, count(*) filter (where hit) as n from fold group by all), g as (select {_G}, count(*) filter (where reversal) as reversals from s4 group by all)
select {_PUBLIC}, reversals, cast(n as int) as stable_runs from g join sb using ({_G}) where reversals > 0 or n > 0""",
    "ma_event_kinds": f"""with recursive {_RULED}, c as (select *, hour_before >= level as opening, ((not below) <> coalesce(lag(not below) over (partition by {_G} order by slot), hour_before >= level))::int as crossed from s4),
g as (select {_G}, bool_or(touched) as touch, cast(sum(crossed) as bigint) as crosses, min(slot) filter (where below) as first_below, max(slot) filter (where not below) as last_above, arg_max(not below, slot) as ends_above, min(abs(range_distance)) as closest,
  max(hour_low) as hour_low, max(final_mean) as final_mean, max(level) as level, bool_and(opening) as opens_above from c group by all),
h as (select *, coalesce(last_above > first_below, not opens_above and last_above is not null, false) as rec, first_below is not null as broke,
  coalesce(not touch and hour_low > level and abs(final_mean / hour_low - 1) * 10000 <= 50, false) as late from g)
select * from (select {_PUBLIC}, case when touch and crosses >= 3 then 'repeated_cross' when touch and opens_above and broke and rec and ends_above then 'break_reclaim' when touch and not opens_above and rec and ends_above then 'reclaim_from_below'
  when touch and broke and not ends_above then 'failed_break' when touch and ends_above then 'touch_hold' when late then 'posthoc_catchup' when not touch and closest <= 30 then 'near_touch' else 'none' end as kind, crosses from h) where kind <> 'none'""",
    "reference_pairs": f"""with {_OUT}, x as (select fin.signal_id, pt.symbol, pt.day, pt.slot, m.strategy_id, return_1b from fin join pt using (signal_id) join (select signal_id, strategy_id from minute_signals where signal_id is not null
  qualify row_number() over (partition by signal_id order by received_at desc nulls last) = 1) m using (signal_id)),
r as (select *, (select min(y.signal_id) from x y where y.symbol = x.symbol and y.day = x.day and y.slot = x.slot and y.strategy_id <> x.strategy_id) as ref from x)
select r.strategy_id, count(*) as pairs, count(r.return_1b - c.return_1b) as known, {o('avg(r.return_1b - c.return_1b)')} as mean, {o('avg(case when r.return_1b > c.return_1b then 1.0 when r.return_1b <= c.return_1b then 0.0 end)')} as positive_share
from r join x c on c.signal_id = r.ref group by 1""",
    "key_audit": " union all ".join(_keys(n, k) for n, k in KEYS.items()),
    "cross_shard_keys": f"""with l as (select distinct shard_id, {day('date_start')} as a, {day('date_end')} as b from status_shard), p as (select x.shard_id as l, y.shard_id as r from l x join l y on x.shard_id < y.shard_id and x.a <= y.b and y.a <= x.b),
k as (select distinct {symbol('symbol')} as symbol, {day('trade_date')} as day, shard_id from security_status), s as (select x.shard_id as l, y.shard_id as r, count(*) as n from k x join k y on x.symbol = y.symbol and x.day = y.day and x.shard_id < y.shard_id group by 1, 2)
select l as left_shard, count(*) as overlapping, cast(coalesce(sum(n), 0) as bigint) as shared_keys from p left join s using (l, r) group by 1""",
    "physical_order": """with x as (select trade_date, symbol, row_number() over () as i from stock_day), y as (select *, lag(trade_date) over (order by i) as d, lag(symbol) over (order by i) as s from x)
select count(*) as rows, count(*) filter (where d > trade_date) as date_back, count(*) filter (where d > trade_date or (d = trade_date and s > symbol)) as key_back from y""",
    "status_daily_consistency": f"""with {DAILY}, {STATUS}, j as (select strftime(sa.day, '%Y-%m') as month, is_suspended as f, coalesce(is_suspended, false) as said, coalesce(volume, 0) <= 0 as idle from sa left join dv on dv.symbol = sa.symbol and dv.day = sa.day)
select month, count(*) as n, count(*) filter (where f is null) as unknown, count(*) filter (where said <> idle) as mismatches, count(*) filter (where not said and idle) as idle_unsuspended, count(*) filter (where said and not idle) as traded_suspended from j group by 1""",
    "factor_changes": f"""with {BARS}, m as (select symbol, strftime(trade_date, '%Y-%m') as month, round(avg(close), 6) as factor from bar group by 1, 2),
p as (select bar.symbol, trade_date as day, open, factor, lag(factor) over w as pf, lag(close) over w as pc, lag(trade_date) over w as pd from bar join m on m.symbol = bar.symbol and m.month = strftime(trade_date, '%Y-%m') window w as (partition by bar.symbol order by trade_date))
select symbol, {date()}, {o('factor / pf')} as factor_ratio, {o('open / pc')} as open_ratio, {o('factor / pf * (open / pc)')} as adjusted_open_ratio, cast(day - pd as int) as gap_days from p where pf > 0 and pc > 0 and factor / pf not between 0.99 and 1.01""",
    "factor_and_day_validity": f"""with {DAILY}, {CAL}, x as (select {symbol('symbol')} as symbol, case when isfinite(adjust_factor) and adjust_factor > 0 then 0 else 1 end as a, 0 as b from stock_day
  union all select symbol, 0, case when ord is null then 1 else 0 end from dv left join cal using (day))
select symbol, cast(sum(a) as bigint) as bad_factors, cast(sum(b) as bigint) as closed_days, count(*) as looked_at from x group by 1""",
    "identity_conflicts": rf"""with h as (select distinct {symbol('symbol')} as symbol, nullif(upper(regexp_replace(name, '[\s\p{{Z}}]', '', 'g')), '') as name from universe_snapshot), i as (select distinct {symbol('symbol')} as symbol from security_status)
select distinct 'orphan_history' as reason, symbol as who from h where symbol not in (from i) union all select 'identity_without_history', symbol from i where symbol not in (select symbol from h)
union all select 'name_of_several', name from h where name is not null group by name having count(*) > 1 union all select 'looked_at', cast(count(distinct symbol) as varchar) from h""",
    "suspension_runs": f"""with {STATUS}, {CAL}, d as (select symbol, sa.day, ord, ord - row_number() over (partition by symbol order by ord) as g from sa join cal on cal.day = sa.day where is_suspended)
select symbol, strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day, count(*) as days, count(*) >= 5 as long from d group by symbol, g""",
    "auxiliary_keys": f"""with {DAILY}, b as (select coalesce(sd.day, dv.day) as day, sd.symbol as x, dv.symbol as y from sd full join dv on sd.symbol = dv.symbol and sd.day = dv.day),
g as (select day, count(*) filter (where y is null) as without_bars, count(*) filter (where x is null) as without_context, count(*) as keys from b where day between (select min(day) from sd) and (select max(day) from sd) group by 1),
e as (select {day('publish_date')} as day, count(*) filter (where {day('feature_available_date')} <= {day('publish_date')}) as known_early, count(*) filter (where {day('feature_available_date')} is null) as never_known from statement_quarterly group by 1)
select {date()}, coalesce(without_bars, 0) as without_bars, coalesce(without_context, 0) as without_context, coalesce(keys, 0) as keys, coalesce(known_early, 0) as known_early, coalesce(never_known, 0) as never_known from g full join (select * from e where day is not null) e using (day)""",
    "latest_parity": f"""with {DAILY}, {STATUS}, p_stock_day as (select symbol, day from sd), p_status as (select symbol, day from sa), p_bars as (select symbol, day from dv)
{_pair('stock_day', 'status')} union all {_pair('status', 'bars')} union all {_pair('bars', 'stock_day')}""",
    "lifecycle_effectivity": f"""with {STATUS}, l as (select {symbol('symbol')} as symbol, min({day('list_date')}) as listed from universe_snapshot group by 1), g as (select symbol, min(day) as gone from sa where is_delisted group by 1),
p as (select sa.*, coalesce(day < listed, false) as early, coalesce(day > gone, false) as late from sa left join l using (symbol) left join g using (symbol))
select symbol, count(*) filter (where early) as before, count(*) filter (where not early and not late) as within, count(*) filter (where late) as after, count(*) filter (where late and is_delisted = false) as came_back from p group by 1""",
    "status_invariants": rf"""with {STATUS}, {SNAP}, b as (select sa.*, said, regexp_matches(nullif(upper(regexp_replace(name, '[\s\p{{Z}}]', '', 'g')), ''), '^(S\*?ST|\*?ST)') as by_name from sa left join sn on sn.symbol = sa.symbol and sn.day = sa.day)
select count(*) as rows, count(*) filter (where is_delisted and is_st) as delisted_st, count(*) filter (where is_delisted and not is_suspended) as delisted_not_suspended, count(*) filter (where is_st is null and is_suspended is null and is_delisted is null) as nothing_known,
  count(*) filter (where by_name <> is_st) as name_against_flag, count(*) filter (where by_name <> said) as name_against_snapshot from b""",
    "minute_daily_quality": f"""with {FIVE}, a as (select {symbol('symbol')} as symbol, {day('trade_date')} as day, max(case when isfinite(high) and high > 0 then high end) as h0, min(case when isfinite(low) and low > 0 then low end) as l0 from minute_bars
  where ({clock('bar_time')}) // 100000 between 931 and 1130 or ({clock('bar_time')}) // 100000 between 1301 and 1500 group by 1, 2),
c as (select symbol, day, max(high) filter (where high > 0) as h1, min(low) filter (where low > 0) as l1 from mrow where t // 100000 > 930 group by 1, 2), g as (select greatest(abs(h0 / h1 - 1), abs(l0 / l1 - 1)) as off from c join a using (symbol, day))
select case when off is null then 'unknown' when off < 1e-9 then 'normal' when off < 0.005 then 'warning' when off < 0.01 then 'soft_warning' when off < 0.05 then 'medium' when off < 0.2 then 'high' else 'critical' end as grade, count(*) as days, {o('max(off)')} as worst from g group by 1""",
    "provider_parity": f"""with r as (select {symbol('symbol')} as symbol, {day('trade_date')} as day, {clock('bar_time')} as t, close, source = 'feed_delta' as one from minute_bars where isfinite(close) and close > 0),
x as (select symbol, day, ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 as slot, t, close, one from r where t // 100000 between 931 and 1130 or t // 100000 between 1301 and 1500),
g as (select symbol, day, slot, last(close order by t, close) filter (where one) as a, last(close order by t, close) filter (where not one) as b from x group by 1, 2, 3)
select {date()}, case when b is null then 'left_only' when a is null then 'right_only' when abs(a - b) > greatest(abs(b) * 0.0005, 0.005) then 'differs' else 'same' end as kind, count(*) as slots from g group by all""",
    "artifact_verification": f"""with {_OUT} select count(*) as rows, count(distinct signal_id) as different, count(*) filter (where fin.reason is null) as signals_without, count(*) filter (where pt.symbol is null and pt.day is null) as outcomes_without,
  count(*) filter (where (reason = 'ok') <> (entry is not null)) as reason_against_entry, count(*) filter (where entry is null and return_1b is not null) as outcome_without_entry from pt full join fin using (signal_id)""",
    "gap_days": f"""with {DAILY}, {CAL}, h as (select symbol, ord, lead(ord) over (partition by symbol order by ord) as nx from dv join cal using (day))
select symbol, strftime(a.day, '%Y-%m-%d') as first_day, strftime(b.day, '%Y-%m-%d') as last_day, cast(nx - h.ord - 1 as int) as days from h join cal a on a.ord = h.ord + 1 join cal b on b.ord = nx - 1 where nx > h.ord + 1""",
    "secondary_validation": f"""with {STATUS}, {SNAP}, j as (select case when sa.symbol is null then 'second_only' when sn.symbol is null then 'first_only' when is_st is not distinct from said then 'same' else 'differs' end as kind, coalesce(cast(is_st as varchar), 'unknown') as first,
  coalesce(cast(said as varchar), 'unknown') as second from sa full join sn on sa.symbol = sn.symbol and sa.day = sn.day) select kind, first, second, count(*) as n from j group by all""",
    "ledger_chain": rf"""with {CAL}, l as (select distinct shard_id, regexp_extract(shard_id, '^(.*)-\d+$', 1) as series, {day('date_start')} as a, {day('date_end')} as b from status_shard),
c as (select *, lag(b) over (partition by series order by a, shard_id) as old from l), d as (select day, lead(day) over (order by day) as due from cal)
select series, case when old is null then 'first' when due is null then 'closed_end' when a < due then 'overlap' when a > due then 'gap' else 'chained' end as kind, count(*) as shards from c left join d on d.day = old group by all""",
}
