"""The queries of ``stores`` once more, as SQL for an independent engine: the content that must be in force in the end."""

from __future__ import annotations

_ORDERS = """o as (select o_orderstatus, case when o_orderkey % 1000 <> 7 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders)"""

ORACLES = {
    "store_append_and_patch": "select s_suppkey, s_name, s_nationkey, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier",
    "store_mutate_and_install": "select s_nationkey, count(*) as n, round(sum(s_acctbal + case when s_nationkey = 20 then 1000 else 0 end), 2) as balance from supplier where s_nationkey < 6 or s_nationkey >= 12 group by 1",
    "store_as_of": f"""with {_ORDERS} select 'as_of' as how, o_orderstatus, count(*) as n from o where day is null or day <= '1998-06-30' group by 2 union all select 'cut', o_orderstatus, count(*) from o where day is null or day <= '1998-06-30' group by 2
union all select 'range', o_orderstatus, count(*) from o where day between '1997-02-01' and '1997-03-15' group by 2""",
    "compressed_events": """with x as (select o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
select o_custkey, o_orderkey, o_totalprice from x where before is null or abs(o_totalprice - before) > 1000 + 0.1 * abs(before)""",
    "bounded_views": """select 'status' as name, count(*) as rows, min(trade_date) as first, max(trade_date) as last from security_status where trade_date between '2001-04-10' and '2001-05-10'
union all select 'context', count(*), min(trade_date), max(trade_date) from stock_day where trade_date between '2001-04-10' and '2001-05-10' union all select 'nation', count(*), null, null from nation""",
    "picked_rows": "select o_custkey, count(*) as orders from orders where o_custkey in (3, 5, 8, 13, 21) group by 1",
    "partition_overwrite": "select p_brand, count(*) as n, cast(sum(p_size) as bigint) as size from part where p_brand <> 'Brand#11' or p_size > 25 group by 1",
}
