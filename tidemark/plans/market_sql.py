"""The queries of ``market`` once more, as SQL for an independent engine."""

from __future__ import annotations

from tidemark.plans.dealt_sql import clock, day, symbol

WINDOWS = (5, 10, 20, 30, 60, 120, 240)
PRICES = ("open", "high", "low", "close")


def o(x: str, digits: int = 6) -> str:
    return f"round({x} + 1.37e-9, {digits})"


def date(x: str = "day") -> str:
    return f"strftime({x}, '%Y-%m-%d') as trade_date"


def complete(agg: str, column: str, first: int, last: int, by: str) -> str:
    side = lambda x: "current row" if x == 0 else f"{abs(x)} {'following' if x > 0 else 'preceding'}"
    w = f"over ({by} rows between {side(first)} and {side(last)})"
    return f"case when count({column}) {w} = {last - first + 1} then {agg}({column}) {w} end"


DAYS = f"""sd as (select {symbol("symbol")} as symbol, {day("trade_date")} as day, max(case when isfinite(adjust_factor) and adjust_factor > 0 then adjust_factor end) as factor, max(industry_name) as industry
  from stock_day group by 1, 2)"""

_FINITE = ", ".join(f"case when isfinite({c}) then {c} end as {c}" for c in (*PRICES, "volume", "amount"))

FIVE = rf"""{DAYS},
mrow as (
  select * from (select {symbol("symbol")} as symbol, {day("trade_date")} as day, {clock("bar_time")} as t, {_FINITE}, received_at from minute_bars)
  where t // 100000 between 925 and 930 or t // 100000 between 931 and 1130 or t // 100000 between 1301 and 1500
  qualify row_number() over (partition by symbol, day, t order by received_at desc nulls last) = 1),
adj as (
  select symbol, day, t, t // 100000 <= 930 as auction, case when t // 100000 <= 930 then 0 else ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 end as slot,
    case when open > 0 and factor > 0 then open * factor end as open, case when high > 0 and low > 0 and high >= low and factor > 0 then high * factor end as high,
    case when high > 0 and low > 0 and high >= low and factor > 0 then low * factor end as low, case when close > 0 and factor > 0 then close * factor end as close,
    case when volume >= 0 then volume end as volume, case when amount >= 0 then amount end as amount
  from mrow join sd using (symbol, day)),
five as materialized (
  select symbol, day, cast(slot as int) as slot, arg_min(open, t) as open, max(high) as high, min(low) as low, arg_max(close, t) as close, coalesce(sum(volume), 0) as volume, coalesce(sum(amount), 0) as amount,
    count(*) filter (where not auction) as bars from adj group by 1, 2, 3)"""

HOURS = f"""{FIVE},
hr as materialized (
  select symbol, day, slot // 12 + 1 as hour, arg_min(open, slot) as open, max(high) as high, min(low) as low, arg_max(close, slot) as close, sum(volume) as volume, sum(amount) as amount
  from five group by 1, 2, 3 having count(*) filter (where bars > 0) = 12)"""


def features(bars: str, order: str, flow: str) -> str:
    by = f"partition by symbol order by day, {order}"
    parts = [f"lag(close, {n}) over ({by}) as lag{n}" for n in WINDOWS]
    for n in WINDOWS:
        for name, agg, c in (("mean", "avg", "close"), ("hi", "max", "high"), ("lo", "min", "low"), ("sd", "stddev_samp", "lg"), ("fl", "avg", flow)):
            parts.append(f"{complete(agg, c, -(n - 1), 0, by)} as {name}{n}")
    out = []
    for n in WINDOWS:
        over = lambda a, b: o(f"{a} / case when {b} > 0 then {b} end - 1")
        out += [f"{over('close', f'lag{n}')} as return_{n}", f"{over('close', f'mean{n}')} as deviation_{n}", f"{over(f'hi{n}', f'lo{n}')} as range_{n}", f"{o(f'sd{n}')} as volatility_{n}", f"{over(flow, f'fl{n}')} as flow_ratio_{n}"]
    return f"""with {bars}, lg as (select *, ln(close / lag(close) over ({by})) as lg from {'hr' if order == 'hour' else 'five'}), w as (select *, {", ".join(parts)} from lg)
select symbol, {date()}, {order}, {", ".join(out)} from w"""


_STATES = f"""{HOURS},
hs as (select symbol, day, hour, high, low, close, period, prior, mean, mean_before, prior / (period - 1) as level from (""" + " union all ".join(
    f"""select *, {p} as period, {complete('sum', 'close', -(p - 1), -1, 'partition by symbol order by day, hour')} as prior, {complete('avg', 'close', -(p - 1), 0, 'partition by symbol order by day, hour')} as mean,
    {complete('avg', 'close', -p, -1, 'partition by symbol order by day, hour')} as mean_before from hr""" for p in (5, 10)) + ")), ht as (select *, coalesce(low <= level and level <= high, false) as touched from hs)"

_POINTS = rf"""
pt as (select signal_id, symbol, day, case when t // 100000 between 931 and 1130 or t // 100000 between 1301 and 1500 then ((t // 10000000) * 60 + (t // 100000) % 100 - case when t < 120000000 then 571 else 661 end) // 5 end as slot, executable from (
  select signal_id, {symbol("symbol")} as symbol, {day("signal_date")} as day, {clock("signal_time")} as t, signal_executable as executable, received_at from minute_signals where signal_id is not null)
  qualify row_number() over (partition by signal_id order by received_at desc nulls last) = 1)"""

_OUT = f"""{FIVE},
cal as (select {day("trade_date")} as day, row_number() over (order by {day("trade_date")}) as ord from trading_calendar where is_open),
ln_ as materialized (select five.*, ord, ord * 48 + slot as place from five join cal using (day)),
dd as materialized (select symbol, ord, max(high) as h, min(low) as l, arg_max(close, slot) as c, count(close) as k from ln_ group by 1, 2),
{_POINTS},
oc as materialized (
  select p.signal_id, p.symbol, p.executable, x.symbol is not null as there, e.open as eopen, case when e.open > 0 then e.open end as entry,
    case when e.place is null then null else true end as has_next,
    {", ".join(f"case when (select count(y.close) from ln_ y where y.symbol = x.symbol and y.place between x.place + 1 and x.place + {1 + n}) = {1 + n} then (select arg_max(y.close, y.place) from ln_ y where y.symbol = x.symbol and y.place between x.place + 1 and x.place + {1 + n}) end as x{n}" for n in (1, 3, 6))},
    {", ".join(f"d{n}.c as c{n}" for n in (1, 2, 3))},
    {", ".join(f"case when {' and '.join(f'd{i}.k = 48' for i in range(1, n + 1))} then greatest({', '.join(f'd{i}.h' for i in range(1, n + 1))}) end as h{n}, case when {' and '.join(f'd{i}.k = 48' for i in range(1, n + 1))} then least({', '.join(f'd{i}.l' for i in range(1, n + 1))}) end as l{n}" for n in (1, 2, 3))}
  from pt p left join ln_ x on x.symbol = p.symbol and x.day = p.day and x.slot = p.slot left join ln_ e on e.symbol = x.symbol and e.place = x.place + 1
  {" ".join(f"left join dd d{n} on d{n}.symbol = x.symbol and d{n}.ord = x.ord + {n}" for n in (1, 2, 3))}),
fin as materialized (select signal_id, symbol, executable, entry, case when not there then 'no_signal_bar' when eopen is null then 'no_next_bar' when not eopen > 0 then 'bad_price' else 'ok' end as reason,
  {", ".join(f"x{n} / entry - 1 as return_{n}b" for n in (1, 3, 6))}, {", ".join(f"c{n} / entry - 1 as return_{n}d, h{n} / entry - 1 as mfe_{n}d, l{n} / entry - 1 as mae_{n}d" for n in (1, 2, 3))} from oc)"""

OUTCOMES = [*[f"return_{n}b" for n in (1, 3, 6)], *[f"{m}_{n}d" for n in (1, 2, 3) for m in ("return", "mfe", "mae")]]

_BAR6 = ", ".join([*[f"{o(c)} as {c}" for c in PRICES], f"{o('volume', 2)} as volume", f"{o('amount', 2)} as amount"])

ORACLES = {
    "session_five_minute": f"with {FIVE} select symbol, {date()}, cast(slot * 5 + case when slot < 24 then 575 else 665 end as int) as end_minute, {_BAR6}, bars from five",
    "field_validity": f"""with x as (select source, {_FINITE} from minute_bars) select source, count(*) as n, count(*) filter (where open > 0) as valid_open, count(*) filter (where high > 0 and low > 0 and high >= low) as valid_high,
  count(*) filter (where high > 0 and low > 0 and high >= low) as valid_low, count(*) filter (where close > 0) as valid_close from x group by 1""",
    "session_hours": f"with {HOURS} select symbol, {date()}, cast(hour as int) as hour, {_BAR6} from hr",
    "complete_sessions": f"with {FIVE} select symbol, {date()}, cast(sum(bars) as bigint) as rows from five group by symbol, day having count(*) filter (where bars > 0 and close is not null) = 48",
    "any_known_value": f"select {symbol('symbol')} as symbol, max(nullif(trim(exchange), '')) as exchange, max(nullif(trim(board), '')) as board from universe_snapshot group by 1",
    "bar_features": features(FIVE, "slot", "volume"),
    "hour_features": features(HOURS, "hour", "amount"),
    "running_hour_state": f"""with {FIVE}, x as (select *, slot // 12 as hour, lag(close) over (partition by symbol order by day, slot) as before from five where close is not null and high is not null and low is not null),
y as (select *, max(high) over w as ph, min(low) over w as pl, first_value(open ignore nulls) over w as po, coalesce(lag(close) over (partition by symbol, day, hour order by slot), before) as pv from x
  window w as (partition by symbol, day, hour order by slot rows between unbounded preceding and current row)),
z as (select *, sum(case when close > pv then amount else 0 end) over w as up, sum(case when close < pv then amount else 0 end) over w as dn from y window w as (partition by symbol, day, hour order by slot rows between unbounded preceding and current row))
select symbol, {date()}, slot, {o('ph')} as partial_high, {o('pl')} as partial_low, {o('close / pl - 1')} as rebound, {o('ph / pl - 1')} as partial_range, {o('case when ph > pl then (close - pl) / (ph - pl) else 0.5 end')} as location,
  {o('least(po, close) / pl - 1')} as lower_wick, {o('case when dn > 0 then up / dn end')} as up_down_ratio from z""",
    "hourly_ma_state": f"""with {_STATES} select symbol, {date()}, cast(hour as int) as hour, period, {o('level')} as level, {o('(mean / mean_before - 1) * 10000', 4)} as slope, touched,
  coalesce(cast(sum(touched::int) over (w rows between 20 preceding and 1 preceding) as bigint), 0) as touches20, coalesce(cast(sum(touched::int) over (w rows between unbounded preceding and 1 preceding) as bigint), 0) as touches
from ht window w as (partition by symbol, period order by day, hour)""",
    "completed_hour_join": f"""with {HOURS}, f as (select * from five where close is not null), d as (select symbol, day, lag(day) over (partition by symbol order by day) as before from (select distinct symbol, day from f))
select f.symbol, {date('f.day')}, f.slot, {o('f.close / hr.close - 1')} as to_hour from f join d on d.symbol = f.symbol and d.day = f.day
left join hr on hr.symbol = f.symbol and hr.day = case when f.slot >= 12 then f.day else d.before end and hr.hour = case when f.slot >= 12 then f.slot // 12 else 4 end""",
    "decision_grid": f"with {FIVE} select symbol, {date()}, slot, dense_rank() over (order by day, slot) as ordinal from five where slot between 5 and 22 or slot between 29 and 45",
    "market_and_industry_minutes": f"""with {FIVE}, x as (select five.*, close / lag(close) over (partition by symbol order by day, slot) - 1 as move from five),
y as (select x.*, unnest(['*', coalesce(nullif(trim(industry), ''), 'UNKNOWN')]) as ind from x join sd using (symbol, day))
select {date()}, slot, ind as industry, count(*) as members, {o('avg(move)')} as mean, {o('avg(case when move > 0 then 1.0 else 0.0 end)')} as breadth, {o('stddev_samp(move)')} as dispersion, {o('sum(amount)', 2)} as amount from y group by day, slot, ind""",
    "execution_window": f"""with {FIVE}, g as (select symbol, day, count(*) filter (where i and close is not null) as bars, max(high) filter (where i) as high, min(low) filter (where i) as low, sum(amount) filter (where f) as a, sum(volume) filter (where f) as v,
  coalesce(arg_min(open, slot) filter (where f), arg_min(open, slot) filter (where i)) as first_price, coalesce(arg_max(close, slot) filter (where f), arg_max(close, slot) filter (where i)) as last_price
  from (select *, slot between 1 and 5 as i, slot between 1 and 5 and volume > 0 and amount > 0 as f from five) group by 1, 2)
select symbol, {date()}, bars, {o('high')} as high, {o('low')} as low, {o('first_price')} as first_price, {o('last_price')} as last_price, {o('a / nullif(v, 0)')} as vwap, bars = 5 as complete, reason = 'ok' as executable, reason from (
  select *, case when bars = 0 then 'missing' when bars <> 5 then 'incomplete' when v is null then 'no_flow' when high <= low then 'one_price' else 'ok' end as reason from g)""",
    "signal_outcomes": f"with {_OUT} select signal_id, {o('entry')} as entry, reason, {', '.join(f'{o(c)} as {c}' for c in OUTCOMES)} from fin",
    "outcomes_scored_once": f"""with {_OUT} select symbol, executable, count(*) as signals, count(return_3b) as known, {o('avg(return_3b)')} as mean3, {o('max(mfe_1d)')} as best, {o('min(mae_1d)')} as worst from fin group by 1, 2""",
    "outcome_coverage": f"with {_OUT} select reason, count(*) as signals, {', '.join(f'count({c}) as {c}' for c in OUTCOMES)} from fin group by 1",
}
