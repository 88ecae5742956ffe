"""Views of the driver tables in the shapes of the market and post data.

The SQL is portable; braces name tables, so that Spark gets DataFrames and other engines names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "v_coin": """
        with li as (select l_partkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as vol from {lineitem} group by l_partkey)
        select p_partkey as pk, concat('P', cast(p_partkey as string)) as symbol, p_name as name,
          p_retailprice / power(1e1, p_size % 8) as price,
          cast((p_partkey * 7919) % 3301 as double) / 1e1 - 165e0 as change_24h,
          vol as volume_24h,
          case when p_size % 10 = 0 then 0e0 else vol * power(1e1, (p_partkey % 5) - 2) end as market_cap,
          case when p_partkey % 7 = 0 then 0e0 else cast((p_partkey * 131) % 2000 as double) * power(1e1, p_partkey % 4) end as liquidity,
          1 + p_size % 3 as risk_level,
          case when p_partkey % 4 = 0 then cast(null as double) else cast(p_partkey % 120 as double) / 1e1 end as smart_money_pct
        from {part} join li on l_partkey = p_partkey
    """,
    "v_tick": """
        select concat('P', cast(l_partkey as string)) as symbol, l_shipdate as ts, l_orderkey, l_linenumber,
          l_extendedprice / l_quantity as close_px from {lineitem} where l_quantity > 0
    """,
    "v_post": """
        select event_id as id, concat('P', cast(user_id as string)) as symbol, ts as created_at,
          case event_type when 'signup' then 'new_listing' when 'purchase' then 'airdrop' when 'error' then 'delisting' when 'click' then 'news' else 'market_move' end as catalyst_type,
          case when event_id % 4 = 0 then null else cast(floor(value * 1e2) as bigint) end as views,
          case when event_id % 3 = 0 then null else cast(floor(value) as bigint) end as traders,
          concat('$P', cast(user_id as string), ' ', case event_id % 8 when 0 then 'Price surge now' when 1 then 'Warning: crash risk' when 2 then 'Whale buying seen' when 3 then 'New listing soon' when 4 then 'The sector shifts' when 5 then 'Is it over?' when 6 then 'Entry zone, target up, stop low' else 'Flat numbers today' end,
            ' #Write2Earn', case when event_id % 4 >= 1 then ' #Altcoins' else '' end, case when event_id % 4 >= 2 then ' #DeFi' else '' end, case when event_id % 4 >= 3 then ' #L1 #L2 #AI' else '' end,
            case when event_id % 5 = 0 then concat(chr(10), chr(10), '  More on this', chr(10), 'Numbers follow', chr(10), 'whale airdrop setup ', repeat('and so on ', 16), 'target') else '' end) as content
        from {events}
    """,
    "v_ann": """
        select event_id as ann_id, ts as released_at,
          case event_type when 'signup' then 'new_listing' when 'purchase' then 'airdrop' when 'error' then 'delisting' else 'news' end as ann_type,
          concat('Exchange Will Update Asset (P', cast(user_id as string), ') and (P', cast((user_id * 7 + 3) % 2000 as string), ')') as title
        from {events} where event_type <> 'view'
    """,
    "v_topic_dim": """
        with t as (select p_type, row_number() over (order by p_type) as i from (select distinct p_type from {part}) x),
          b as (select p_brand, row_number() over (order by p_brand) as i from (select distinct p_brand from {part}) y)
        select t.i as ord, p.p_type as topic, concat('P', cast(p_partkey as string)) as symbol from {part} p join t on t.p_type = p.p_type
        union all select 100 + b.i, p.p_brand, concat('P', cast(p_partkey as string)) from {part} p join b on b.p_brand = p.p_brand where p_size <= 30
    """,
    "v_symbol": "select p_partkey as pk, concat('P', cast(p_partkey as string)) as symbol from {part} where p_partkey in (select l_partkey from {lineitem})",
    "v_listed": "select symbol from {v_symbol} where pk % 9 <> 0",
    "v_rank": """
        select s.rank_type, s.source, c.chain_id, v.pk, v.symbol from {v_coin} v
          cross join (select 10 as rank_type, 'trending' as source, 2 as m union all select 11, 'top_search', 3 union all select 20, 'alpha', 5
            union all select 30, 'smart_money', 7 union all select 40, 'stock', 11 union all select 50, 'futures', 13) s
          cross join (select '56' as chain_id, 2 as cm union all select '1', 3) c
          where v.pk % s.m = 0 and v.pk % c.cm = 0
    """,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables in ``sf_dir``."""
    parts = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    frames = {p: view(spark, sf_dir, p) if p in VIEWS else spark.read.parquet(f"{sf_dir}/{p}.parquet") for p in parts}
    return spark.sql(VIEWS[name], **frames)


def with_views(sql: str) -> str:
    """``sql`` with the views that it names put before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(VIEWS[name].replace("{" + name + "}", name))
                needed.append(name)

    add(sql)
    heads = [f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in needed]
    body = sql.strip()
    if found := re.match(r"(?i)with (recursive )?", body):
        return f"with {found[1] or ''}" + ", ".join([*heads, body[found.end() :]])
    return f"with {', '.join(heads)} {body}" if heads else body
