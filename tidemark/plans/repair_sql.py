"""The queries of ``repair`` once more, as SQL for an independent engine."""

from __future__ import annotations

from tidemark.plans.audits_sql import DAILY
from tidemark.plans.dealt_sql import _PLAIN, _WIDE, clock, day, flag, symbol
from tidemark.plans.market_sql import FIVE, date, o
from tidemark.plans.reference_sql import BARS

_SUFFIXES = "证券股份有限公司|证券有限责任公司|股份有限公司|有限责任公司|有限公司|证券研究院|证券研究所|研究院|研究所|证券"


def fin(x: str) -> str:
    return f"case when isfinite({x}) then {x} end"


def _domain(name: str, table: str, keys: list[str], value: str) -> str:
    named = ", ".join(f"{k} as k{i}" for i, k in enumerate(keys))
    by = ", ".join(f"k{i}" for i in range(len(keys)))
    return f"""select '{name}' as domain, count(*) as keys, count(v) as known from (select * from (select {named}, {value} as v, received_at from {table}) where {" and ".join(f"k{i} is not null" for i in range(len(keys)))}
  qualify row_number() over (partition by {by} order by received_at desc nulls last) = 1)"""


def g(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1)"


def part(a: str) -> str:
    return f"({a} / case when ta > 0 then ta end)"


_VECTOR = {
    "first_5m_ret": g("c1", "o1"), "first_15m_ret": g("c3", "o1"), "first_30m_ret": g("c6", "o1"), "first_5m_share": part("a1"), "first_30m_share": part("a6"), "open_range": g("hi_open", "lo_open"), "first_30m_range": g("hi_open6", "lo_open6"),
    "open_pressure": f"{g('c1', 'o1')} * {part('a1')}", "last_5m_ret": g("last", "last2"), "last_30m_ret": g("last", "o_back6"), "last_5m_share": part("z1"), "last_30m_share": part("z6"), "close_range": g("hi_close", "lo_close"), "last_30m_range": g("hi_close6", "lo_close6"),
    "close_pressure": f"{g('last', 'last2')} * {part('z1')}", "close_pressure_30m": f"{g('last', 'o_back6')} * {part('z6')}", "day_ret": g("last", "o1"), "vwap": "vwap", "close_to_vwap": g("last", "vwap"), "day_range": g("hi", "lo"), "close_position": "case when hi > lo then (last - lo) / (hi - lo) end",
    "realised_vol": "sd", "log_vol": "sd_log", "high_time": "case when n > 1 then (p_hi - 1) / (n - 1) end", "low_time": "case when n > 1 then (p_lo - 1) / (n - 1) end", "high_first": "case when p_hi = p_lo then 0.5 when p_hi < p_lo then 1.0 else 0.0 end",
    "open_to_high": g("hi", "o1"), "open_to_low": g("lo", "o1"), "high_to_close": g("last", "hi"), "low_to_close": g("last", "lo"), "drawdown": "drawdown", "runup": "runup", "above_vwap": "above_vwap", "cum_vwap_slope": "cum_slope", "top_share": "top_share", "hhi": "hhi",
    "lunch_gap": g("pm_open", "am_close"), "am_ret": g("am_close", "am_open"), "pm_ret": g("pm_close", "pm_open"), "am_pm_ret": f"{g('pm_close', 'pm_open')} - {g('am_close', 'am_open')}", "am_pm_vol": "sd_pm - sd_am", "am_share": part("am_amount"),
    "early_late": f"{g('c6', 'o1')} - {g('last', 'o_back6')}", "volume_acceleration": "v5 / case when v20 > 0 then v20 end - 1", "close_location": "case when last_hi > last_lo then (last - last_lo) / (last_hi - last_lo) else 0.5 end",
    "open_gap": "og", "gap_follow": f"sign(og) * {g('c6', 'o1')}", "gap_reversal": f"-sign(og) * {g('c6', 'o1')}",
}
_WHERE = {"open": "pos = 1", "open6": "pos <= 6", "close": "back = 0", "close6": "back < 6"}

ORACLES = {
    "alias_headers": f"select {symbol('symbol')} as symbol, count(*) as rows, {o(f'max({fin('close')})')} as high_close, {o('sum(case when isfinite(volume) and volume >= 0 then volume end)', 2)} as volume from minute_bars group by 1",
    "domain_normalisers": " union all ".join([
        _domain("universe", "universe_snapshot", [symbol("symbol"), day("trade_date")], r"nullif(regexp_replace(name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '')"), _domain("status", "security_status", [symbol("symbol"), day("trade_date")], "is_st"),
        _domain("archive", "archive_status", [symbol("code"), day("trade_date")], flag("archive_is_st")), _domain("financial", "statement_quarterly", ["statement_id"], fin("revenue")), _domain("signal", "minute_signals", ["signal_id"], fin("selection_score"))]),
    "excluded_projection": "select * exclude (n_regionkey), n_regionkey from nation",
    "valuation_override": f"""with {DAILY}, st as (select {symbol('symbol')} as symbol, row({day('report_date')}, statement_id) as rk, {fin('net_profit')} as p, {fin('eps')} as e, {fin('revenue')} as v from statement_quarterly where statement_id is not null),
l as (select symbol, last(p order by rk) as p, last(e order by rk) as e, last(v order by rk) as v from st group by 1), c as (select symbol, arg_max(close, day) as close from dv where close > 0 group by 1),
x as (select symbol, close, p / case when abs(e) >= 0.001 then e end as a, v / 2 as b from l join c using (symbol))
select symbol, {o('coalesce(case when a > 0 then a end, case when b > 0 then b end) / 1e6', 4)} as million_shares, {o('close * coalesce(case when a > 0 then a end, case when b > 0 then b end) / 1e6', 3)} as million_value,
  case when a > 0 then 'profit_by_eps' when b > 0 then 'half_revenue' else 'unknown' end as shares_from from x""",
    "statement_semantics": f"""with x as (select fiscal_quarter, {fin('revenue')} as r, {fin('net_profit')} as a, {fin('eps')} as b, {fin('roe_avg')} as p from statement_quarterly where statement_id is not null),
y as (select *, coalesce(r, a + b) + coalesce(p, 0) as total, case when r is not null and p is not null then 'reported_plus_part' when r is not null then 'reported_part_unreported' when a is not null and b is not null and p is not null then 'components_plus_part'
  when a is not null and b is not null then 'components_part_unreported' else 'unknown' end as state from x) select fiscal_quarter, state, count(*) as n, count(total) as known, {o('avg(total / 1e6)', 3)} as mean_millions from y group by all""",
    "institution_identity": rf"""select nullif(regexp_replace(regexp_replace(lower(translate(regexp_replace(institution, '[\s\p{{Z}}]', '', 'g'), '{_WIDE}', '{_PLAIN}')), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]', '', 'g'), '(?:{_SUFFIXES})+$', ''), '') as institution,
  case when title like '%季度%' then 'quarterly' when title like '%产能%' then 'capacity' when title like '%首次%' then 'initiation' when title like '%跟踪%' then 'follow_up' when title like '%点评%' then 'comment' else 'other' end as category, count(*) as reports from research_report group by all""",
    "function_catalogue": r"""select p_partkey, round(ln(p_retailprice), 8) as ln, round(sqrt(p_retailprice), 8) as sqrt, abs(-p_retailprice) as abs, cast(sign(p_retailprice - 1000) as int) as sign, cast(floor(p_retailprice) as bigint) as floor, cast(ceil(p_retailprice) as bigint) as ceil,
  round(sin(2 * pi() * p_size / 50), 8) + 0.0 as sin, round(cos(2 * pi() * p_size / 50), 8) + 0.0 as cos, greatest(p_retailprice, 1000.0) as greatest, least(p_retailprice, 1000.0) as least, strftime(d, '%Y-%m-%d') as date, cast(year(d) as int) as year, cast(d - date '1990-06-15' as int) as days,
  strftime(d, '%Y%m') as month, upper(trim(p_name)) as upper, lower(p_brand) as lower, substr(p_type, 1, 5) as substr, concat_ws('|', p_brand, p_type) as concat, p_brand like 'Brand#1%' as like, regexp_extract(p_brand, '(\d+)$', 1) as extract, regexp_replace(p_type, '[A-Z]+ ', '', 'g') as replace,
  regexp_matches(p_type, '^[A-Z]+ ') as matches, md5(p_brand) as md5, sha256(p_brand) as sha256, p_size * 1000000 as shares from (select *, date '1995-01-01' + cast(p_partkey % 2000 as int) as d from part)""",
    "cost_models": f"""with {BARS}, x as (select symbol, close, lead(close, 5) over w as later, case when lead(trade_date, 5) over w >= date '2001-01-01' then 0.0005 else 0.001 end as duty from bar window w as (partition by symbol order by trade_date)),
y as (select symbol, later * (1 - 0.0007) * (1 - (0.0003 + duty)) / (close * (1 + 0.0007) * (1 + 0.0003)) - 1 as p, later / close - 1 - 2 * 0.0007 - 2 * 0.0003 - duty as q from x where later is not null)
select symbol, count(*) as n, {o('avg(p)')} as multiplicative, {o('avg(q)')} as additive, {o('max(abs(p - q))')} as furthest from y group by 1""",
    "repair_candidates": f"""with {FIVE}, w as (select *, ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 as slot from mrow where t // 100000 > 930 and open > 0 and close > 0 and high > 0 and low > 0),
m as (select symbol, day, median(c) as ref from (select symbol, day, arg_max(close, t) as c from w group by symbol, day, slot) group by 1, 2),
x as (select symbol, day, unnest(['high', 'low']) as field, unnest([high, low]) as before, unnest([greatest(open, close), least(open, close)]) as after, ref from w join m using (symbol, day)),
y as (select symbol, day, field, abs(before / ref - 1) as b, abs(after / ref - 1) as a from x where abs(before / ref - 1) > 0.01)
select symbol, {date()}, field, case when not a < b then 'rejected' when a <= 0.01 then 'cleared' when 1 - a / b >= 0.5 and a <= 0.05 then 'improved' else 'rejected' end as outcome, count(*) as rows, {o('max(b)')} as worst_before, {o('max(a)')} as worst_after from y group by symbol, day, field, 4""",
    "mislabelled_minutes": f"""with x as (select {symbol('symbol')} as symbol, {day('trade_date')} as day, ({clock('bar_time')}) // 100000 as m from minute_bars)
select symbol, {date()}, '1301' as original, '1130' as repaired, count(*) filter (where m = 1301) as rows from x group by symbol, day having count(*) filter (where m = 1301) > 0 and count(*) filter (where m = 1130) = 0""",
    "flow_eligible_prices": f"""with {FIVE}, x as (select *, coalesce(volume > 20000, false) as flow from mrow where open > 0 and close > 0), y as (select *, bool_or(flow) over (partition by symbol, day) as has from x)
select symbol, {date()}, bool_or(has) as has_flow, count(*) as rows, {o('arg_min(open, t)')} as first_price, {o('arg_max(close, t)')} as last_price from y where not has or flow group by symbol, day""",
    "share_inference": f"""with {DAILY}, e as (select {symbol('symbol')} as symbol, {day('feature_available_date')} as known, arg_max({fin('net_profit')} / case when abs({fin('eps')}) >= 0.001 then {fin('eps')} end, statement_id) as shares from statement_quarterly
  where statement_id is not null and {fin('net_profit')} / case when abs({fin('eps')}) >= 0.001 then {fin('eps')} end > 0 group by 1, 2),
a as (select dv.symbol, dv.day, volume, known, shares from dv asof left join (select * from e where known is not null) e on dv.symbol = e.symbol and dv.day >= e.known),
t as (select *, volume / (case when date_diff('day', date '1970-01-01', day) % 3 <> 0 and volume / shares > 0 then volume / shares end) as implied from a),
c as (select *, last_value(implied ignore nulls) over (partition by symbol order by day rows between unbounded preceding and current row) as carried, coalesce(known > day - 60, false) as own from t)
select symbol, {date()}, {o('case when own then shares else carried end / 1e6', 3)} as million_shares, case when own then 'statement' when carried is not null then 'turnover' else 'unknown' end as shares_from from c""",
    "factor_continuation": f"""with {BARS}, x as (select *, case when volume > 5 then close end as provider from bar), y as (select *, coalesce(ln(provider / lag(provider) over (partition by symbol order by trade_date)), 0) as step from x),
z as (select *, sum(step) over (partition by symbol order by trade_date rows unbounded preceding) as factor from y) select symbol, count(*) filter (where step <> 0) as carried, {o('arg_max(factor, trade_date)', 5)} as last_log, {o('max(factor)', 5)} as highest_log from z group by 1""",
    "factor_boundaries": f"""with {BARS}, x as (select a.symbol, a.trade_date, a.close / b.close as ratio from bar a join bar b on b.symbol = a.symbol + 1 and b.trade_date = a.trade_date),
y as (select symbol, count(*) as days, median(ratio) as scale, arg_min(ratio, trade_date) as f, arg_max(ratio, trade_date) as l from x group by 1) select symbol, days, {o('scale')} as scale, abs(f / scale - 1) <= 0.01 as first_agrees, abs(l / scale - 1) <= 0.01 as last_agrees from y""",
    "daily_feature_vector": f"""with {FIVE}, a as (select *, row_number() over w as pos, count(*) over (partition by symbol, day) as n, close / lag(close) over w - 1 as ret, max(close) over r as peak, min(close) over r as trough, sum(amount) over r / case when sum(volume) over r > 0 then sum(volume) over r end as cum,
    sum(amount) over (partition by symbol, day) as ta, sum(volume) over (partition by symbol, day) as tv, slot < 24 as am from five where open is not null and high is not null and low is not null and close is not null
  window w as (partition by symbol, day order by slot), r as (partition by symbol, day order by slot rows unbounded preceding)),
b as (select *, n - pos as back, ta / case when tv > 0 then tv end as vw, amount / case when ta > 0 then ta end as share from a),
c as (select symbol, day, count(*) as n, max(open) filter (where pos = 1) as o1, {", ".join(f"max(close) filter (where pos = {k}) as c{k}" for k in (1, 3, 6))}, max(close) filter (where back = 0) as last, max(close) filter (where back = 1) as last2, max(open) filter (where back = 5) as o_back6, max(high) as hi, min(low) as lo, max(ta) as ta, max(vw) as vwap,
  {", ".join(f"sum(amount) filter (where pos <= {k}) as a{k}, sum(amount) filter (where back < {k}) as z{k}" for k in (1, 6))}, {", ".join(f"max(high) filter (where {w}) as hi_{k}, min(low) filter (where {w}) as lo_{k}" for k, w in _WHERE.items())},
  stddev_samp(ret) as sd, stddev_samp(ln(1 + ret)) as sd_log, stddev_samp(ret) filter (where am) as sd_am, stddev_samp(ret) filter (where not am) as sd_pm, first(pos order by high desc, pos) as p_hi, first(pos order by low, pos) as p_lo, min(close / peak - 1) as drawdown, max(close / trough - 1) as runup,
  avg((close > vw)::int) as above_vwap, max(share) as top_share, sum(share * share) as hhi, (count(cum) * sum(pos * cum) - sum(pos) filter (where cum is not null) * sum(cum)) / nullif(count(cum) * sum(pos * pos) filter (where cum is not null) - (sum(pos) filter (where cum is not null)) * (sum(pos) filter (where cum is not null)), 0) as cum_slope,
  arg_min(open, slot) filter (where am) as am_open, arg_max(close, slot) filter (where am) as am_close, arg_min(open, slot) filter (where not am) as pm_open, arg_max(close, slot) filter (where not am) as pm_close, sum(amount) filter (where am) as am_amount,
  avg(volume) filter (where back < 5) as v5, avg(volume) filter (where back >= 5 and back < 25) as v20, max(high) filter (where back = 0) as last_hi, max(low) filter (where back = 0) as last_lo from b group by symbol, day),
d as (select *, o1 / lag(last) over (partition by symbol order by day) - 1 as og from c)
select symbol, {date()}, n, {", ".join(f"{o(x, 5 if k == 'cum_vwap_slope' else 6)} as {k}" for k, x in _VECTOR.items())} from d""",
}
