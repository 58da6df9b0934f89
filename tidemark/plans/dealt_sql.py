"""The general data problems once more, as SQL for an independent engine to check them with."""

from __future__ import annotations

#: NFKC of the full-width forms of ASCII, made from their rule; the names use no other compatibility characters.
_WIDE = "".join(chr(0xFEE0 + x) for x in range(0x21, 0x7F))
_PLAIN = "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''")


def day(x: str) -> str:
    return rf"try_cast(regexp_replace(trim({x}), '^(\d{{4}})[-/.]?(\d{{1,2}})[-/.]?(\d{{1,2}})([ T].*)?$', '\1-\2-\3') as date)"


def clock(x: str) -> str:
    """HHMMSSmmm as a number."""
    d = rf"regexp_replace(regexp_replace({x}, '\.0*\s*$', ''), '[\s:.]', '', 'g')"
    return f"""case when length({d}) in (3, 4) then try_cast({d} as bigint) * 100000 when length({d}) in (5, 6) then try_cast({d} as bigint) * 1000
        when length({d}) between 7 and 9 then try_cast({d} as bigint) end"""


def symbol(x: str) -> str:
    c = rf"upper(regexp_replace({x}, '[\s.]', '', 'g'))"
    n = rf"regexp_extract({c}, '\d{{6}}')"
    e = rf"regexp_extract({c}, '[A-Z]{{2}}')"
    return f"({n} || '.' || case when {e} <> '' then {e} when {n}[1] in ('5', '6', '9') then 'SH' when {n}[1] in ('4', '8') then 'BJ' else 'SZ' end)"


def flag(x: str) -> str:
    return f"case when lower(trim({x})) in ('1', '1.0', 't', 'true', 'y', 'yes') then true when lower(trim({x})) in ('0', '0.0', 'f', 'false', 'n', 'no') then false end"


_LATEST = "row_number() over (partition by {keys} order by received_at desc nulls last) = 1"

_SNAPSHOTS = rf"""
snap as (
  select symbol, day, name, is_st, first_event from (
    select {symbol("symbol")} as symbol, {day("trade_date")} as day, received_at, is_st, {day("first_event_date")} as first_event,
      nullif(upper(translate(regexp_replace(name, '[\s\p{{Z}}]', '', 'g'), '{_WIDE}', '{_PLAIN}')), '') as name
    from universe_snapshot)
  qualify {_LATEST.format(keys="symbol, day")}),
known as (
  select symbol, day, name, is_st, first_event, row_number() over w as rn,
    last_value(name ignore nulls) over p as name0, last_value(is_st ignore nulls) over p as st0, last_value(first_event ignore nulls) over p as fe0,
    last_value(name ignore nulls) over c as name1, last_value(is_st ignore nulls) over c as st1, last_value(first_event ignore nulls) over c as fe1
  from snap
  window w as (partition by symbol order by day), p as (partition by symbol order by day rows between unbounded preceding and 1 preceding),
    c as (partition by symbol order by day rows between unbounded preceding and current row)),
version as (
  select * from known where rn = 1 or (name is not null and name is distinct from name0) or (is_st is not null and is_st is distinct from st0)
    or (first_event is not null and first_event is distinct from fe0))"""

_BARS = rf"""
bar as (
  select symbol, day, t, amount, close from (
    select {symbol("symbol")} as symbol, {day("trade_date")} as day, {clock("bar_time")} as t, amount, close, received_at from minute_bars)
  where t // 100000 between 931 and 1130 or t // 100000 between 1301 and 1500
  qualify {_LATEST.format(keys="symbol, day, t")})"""

_TOTALS = rf"""
with {_BARS},
total as (select symbol, day, sum(case when isfinite(amount) and amount >= 0 then amount else 0 end) as amount from bar group by 1, 2),
cal as (select {day("trade_date")} as day, row_number() over (order by {day("trade_date")}) as ord from trading_calendar where is_open),
span as (select symbol, min(day) as a, max(day) as b from {{spans}} group by 1),
target as (select symbol, cal.day, ord from span join cal on cal.day between a and b),
med as (
  select t.symbol, t.day, median(coalesce(x.amount, 0)) as m from target t join cal on cal.ord between t.ord - 20 and t.ord - 1
  left join total x on x.symbol = t.symbol and x.day = cal.day group by 1, 2),
sums as (
  select t.symbol, t.day, coalesce(sum(x.amount) filter (where x.day > t.day - 7), 0) as s7, coalesce(sum(x.amount), 0) / 30 as m30,
    coalesce(sum(x.amount) filter (where x.day = t.day), 0) as s1
  from target t left join total x on x.symbol = t.symbol and x.day between t.day - 29 and t.day group by 1, 2)"""

_SIGNALS = rf"""
sig as (select * from (
  select signal_id, {symbol("symbol")} as symbol, {day("signal_date")} as day, received_at from minute_signals where signal_id is not null)
  qualify {_LATEST.format(keys="signal_id")})"""

_KNOWN = rf"""
with {_SIGNALS},
st as (select {symbol("symbol")} as symbol, statement_id, update_flag, {day("report_date")} as rep, {day("feature_available_date")} as avail from statement_quarterly),
pick as (
  select signal_id, sig.symbol, sig.day, statement_id, rep, avail from sig left join st on st.symbol = sig.symbol and st.avail <= sig.day
  qualify row_number() over (partition by signal_id order by rep desc nulls last, avail desc nulls last, update_flag desc nulls last, statement_id desc nulls last) = 1)"""

_COPIES = rf"""
a as (select * from (
  select {symbol("symbol")} as symbol, {day("trade_date")} as day, is_st, is_suspended, is_delisted, shard_id, received_at from security_status)
  qualify {_LATEST.format(keys="symbol, day")}),
b as (select * from (
  select {symbol("code")} as symbol, {day("trade_date")} as day, {flag("archive_is_st")} as is_st, {flag("archive_is_suspended")} as is_suspended,
    {flag("archive_is_delisted")} as is_delisted, received_at from archive_status)
  qualify {_LATEST.format(keys="symbol, day")}),
both_ as (select a.symbol, a.day, a.shard_id, a.is_st as x1, b.is_st as y1, a.is_suspended as x2, b.is_suspended as y2, a.is_delisted as x3, b.is_delisted as y3
  from a join b on a.symbol = b.symbol and a.day = b.day)"""

ORACLES = {
    "p1_history": f"""with {_SNAPSHOTS}
select symbol, strftime(day, '%Y-%m-%d') as valid_from, strftime(lead(day) over (partition by symbol order by day) - 1, '%Y-%m-%d') as valid_to,
  name1 as name, st1 as is_st, strftime(fe1, '%Y-%m-%d') as first_event_date from version""",
    "p1_found": f"with {_SNAPSHOTS} select symbol, strftime(day, '%Y-%m-%d') as valid_from from version",
    "p2_totals": f"""{_TOTALS.replace("{spans}", "total")}
select symbol, strftime(day, '%Y-%m-%d') as trade_date, round(s1, 2) as day_amount, round(m, 2) as prior_20d_median_amount, round(s7, 2) as amount_sum_7d,
  round(m30, 2) as amount_mean_30d from sums join med using (symbol, day)""",
    "p2_found": f"""{_TOTALS.replace("{spans}", f"(select {symbol('symbol')} as symbol, {day('trade_date')} as day from stock_day)")},
off as (
  select s.symbol, s.day, unnest([
    case when coalesce(abs(d.prior_20d_median_amount - m) <= 0.05, false) then null else 'prior_20d_median_amount' end,
    case when coalesce(abs(d.amount_sum_7d - s7) <= 0.05, false) then null else 'amount_sum_7d' end,
    case when coalesce(abs(d.amount_mean_30d - m30) <= 0.05, false) then null else 'amount_mean_30d' end]) as field_name
  from stock_day d join sums s on s.symbol = {symbol("d.symbol")} and s.day = {day("d.trade_date")} join med on med.symbol = s.symbol and med.day = s.day)
select distinct symbol, strftime(day, '%Y-%m-%d') as trade_date, field_name from off where field_name is not null""",
    "p3_known": f"""{_KNOWN}
select signal_id, symbol, strftime(day, '%Y-%m-%d') as signal_date, cast(statement_id as varchar) as statement_id, strftime(rep, '%Y-%m-%d') as report_date,
  strftime(avail, '%Y-%m-%d') as feature_available_date from pick""",
    "p3_found": f"{_KNOWN} select signal_id, statement_id from pick where statement_id is not null",
    "p6_found": f"""with {_BARS},
every as (select distinct {symbol("symbol")} as symbol, {day("trade_date")} as day from minute_bars),
seen as (
  select distinct symbol, day, ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 as slot
  from bar where isfinite(close) and close > 0)
select e.symbol, strftime(e.day, '%Y-%m-%d') as trade_date, cast(s.slot as int) as slot
from every e cross join range(48) as s(slot) left join seen x on x.symbol = e.symbol and x.day = e.day and x.slot = s.slot where x.slot is null""",
    "p6_cells": f"""with {_BARS},
every as (select distinct {symbol("symbol")} as symbol, {day("trade_date")} as day from minute_bars),
seen as (select symbol, day, ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 as slot, arg_max(close, t) as close from bar where isfinite(close) and close > 0 group by 1, 2, 3),
rows_ as (select distinct symbol, day from seen), cols as (select distinct day, slot from seen)
select e.symbol, strftime(e.day, '%Y-%m-%d') as trade_date, cast(s.slot as int) as slot, case when x.slot is not null then 'observed' when r.symbol is not null and c.day is not null then 'filled' else 'unsupported' end as status, x.close
from every e cross join range(48) as s(slot) left join seen x on x.symbol = e.symbol and x.day = e.day and x.slot = s.slot left join rows_ r on r.symbol = e.symbol and r.day = e.day left join cols c on c.day = e.day and c.slot = s.slot""",
    "p7_found": f"""with {_COPIES}
select a.symbol as record_key, strftime(a.day, '%Y-%m-%d') as trade_date, 'missing_in_archive' as field_name from a anti join b on a.symbol = b.symbol and a.day = b.day
union all select b.symbol, strftime(b.day, '%Y-%m-%d'), 'missing_in_status' from b anti join a on a.symbol = b.symbol and a.day = b.day
union all select symbol, strftime(day, '%Y-%m-%d'), 'is_st' from both_ where x1 is distinct from y1
union all select symbol, strftime(day, '%Y-%m-%d'), 'is_suspended' from both_ where x2 is distinct from y2
union all select symbol, strftime(day, '%Y-%m-%d'), 'is_delisted' from both_ where x3 is distinct from y3
union all select shard_id, date_start, 'changed_rows' from status_shard s left join (
  select shard_id, count(*) as n from both_ where x1 is distinct from y1 group by 1) c using (shard_id) where changed_rows is distinct from coalesce(n, 0)""",
}
