"""Every query by name over the driver tables, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions import text

from signalmill.operators import filters, history, lookup, reports, research, routing, scoring, topics
from signalmill.sources import feeds, landing, tables
from signalmill.sources.fixtures import AS_OF, view, with_views
from signalmill.streaming import audits, scans
from signalmill.streaming import posts as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL over the views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(expand(sql))
        return f

    return add


#: Parts of SQL that several queries share; ``$name`` in a query pulls one in, with those it needs.
PARTS = {
    "assets": """
        select *, pk as ord, least(greatest(volume_24h / greatest(market_cap, 1e0) * 100, 3e-1), 1e1) as volume_ratio,
          case pk % 6 when 0 then 'AI' when 1 then 'MEME' when 2 then 'L1' when 3 then 'RWA' when 4 then 'DeFi' else '' end as category from v_coin""",
    "named": r"""
        select ann_id, ann_type, title, x.symbol from (select *, unnest(regexp_extract_all(title, '\(([A-Z0-9]{2,10})\)', 1)) as symbol from v_ann) x join v_coin c on c.symbol = x.symbol""",
    "firsts": "select symbol, min(ann_id) as ann_id, arg_min(ann_type, ann_id) as catalyst from $named group by symbol",
    "ages": f"select symbol, (epoch_us(timestamp '{AS_OF}') - epoch_us(max(created_at))) / 3.6e9 as hours_ago from v_post group by symbol",
    "rich": """
        select a.*, f.catalyst, g.hours_ago, l.symbol is not null as listed from $assets a left join $firsts f on f.symbol = a.symbol
          left join $ages g on g.symbol = a.symbol left join v_listed l on l.symbol = a.symbol""",
    "feed": """
        select symbol, list(source order by rank_type, chain_id) as sources, count(*) as n_entries, count(distinct source) as n_sources from v_rank group by symbol""",
    "parts": """
        select a.*, n_sources, sources, pk % 3 = 0 as tagged,
          case when list_contains(sources, 'trending') then 1e2 else 0e0 end as c_trending,
          least(coalesce(smart_money_pct, 0e0) * 10, 1e2) as c_smart_money, list_contains(sources, 'smart_money') or coalesce(smart_money_pct, 0e0) > 0 as a_smart_money,
          case when list_contains(sources, 'top_search') then 1e2 else 0e0 end as c_top_search,
          case when market_cap <> 0 then least(volume_24h / market_cap * 500, 1e2) else 0e0 end as c_volume, volume_24h > 0 and market_cap > 0 as a_volume,
          case when market_cap >= 1e9 then 1e2 when market_cap >= 1e8 then 8e1 when market_cap >= 1e7 then 6e1 when market_cap >= 1e6 then 4e1 when market_cap > 0 then 2e1 else 0e0 end as c_market_cap, market_cap > 0 as a_market_cap,
          case when liquidity >= 1e6 then 1e2 when liquidity >= 1e5 then 8e1 when liquidity >= 1e4 then 6e1 when liquidity > 0 then 4e1 else 0e0 end as c_liquidity, liquidity > 0 as a_liquidity,
          case when abs(change_24h) >= 20 then 1e2 when abs(change_24h) >= 10 then 8e1 when abs(change_24h) >= 5 then 6e1 when abs(change_24h) >= 2 then 4e1 else 2e1 end as c_momentum,
          least(least(25e0 * n_sources, 1e2) + case when pk % 3 = 0 then 2e1 else 0e0 end, 1e2) as c_quality
        from $assets a join $feed f on f.symbol = a.symbol""",
    "scored": """
        select *, case when score >= 75 then 'direct' when score >= 60 then 'review' else 'reject' end as decision from (select *, floor(least(greatest((
            (0e0 + c_trending * 0.20::double + case when a_smart_money then c_smart_money * 0.20::double else 0e0 end + c_top_search * 0.15::double + case when a_volume then c_volume * 0.15::double else 0e0 end
             + case when a_market_cap then c_market_cap * 0.10::double else 0e0 end + case when a_liquidity then c_liquidity * 0.10::double else 0e0 end + c_momentum * 0.05::double + c_quality * 0.05::double)
            / (0e0 + 0.20::double + case when a_smart_money then 0.20::double else 0e0 end + 0.15::double + case when a_volume then 0.15::double else 0e0 end + case when a_market_cap then 0.10::double else 0e0 end
             + case when a_liquidity then 0.10::double else 0e0 end + 0.05::double + 0.05::double)
            + (case when n_sources >= 3 then 5e0 else 0e0 end + case when list_contains(sources, 'trending') then 5e0 else 0e0 end + case when list_contains(sources, 'top_search') then 5e0 else 0e0 end
             + case when list_contains(sources, 'smart_money') then 5e0 else 0e0 end + case when list_contains(sources, 'alpha') then 5e0 else 0e0 end))
            * case when risk_level >= 3 then 5e-1 when risk_level = 2 then 8e-1 else 1e0 end * case when price > 0 and price < 1e-4 then 3e-1 when price > 0 and price < 1e-3 then 6e-1 else 1e0 end,
          0e0), 1e2) * 10 + 5e-1) / 10 as score from $parts)""",
    "reasons": """
        select symbol, case
          when symbol = '' then 'empty symbol' when price <= 0 or price < 1e-4 then 'price too low' when market_cap > 0 and market_cap < 1e5 then 'market cap too low'
          when abs(change_24h) > 150 then 'extreme move' when liquidity > 0 and liquidity < 1e4 then 'liquidity too low' when risk_level >= 3 then 'high risk'
          when catalyst is null and not (abs(change_24h) > 2.5 or volume_ratio > 1.5) then 'no catalyst'
          when hours_ago is not null and not ex and hours_ago < 12 then 'hard cooldown' when hours_ago is not null and not ex and hours_ago < 24 then 'soft cooldown'
          when hours_ago is not null and not ex and hours_ago < 48 and abs(change_24h) < 5 then 'weak move in cooldown' when not listed then 'not listed'
          when pk <= 5 and (not ex or abs(change_24h) < 5) then 'top symbol without reason' end as reason
        from (select *, coalesce(catalyst in ('new_listing', 'launchpool', 'megadrop', 'airdrop', 'delisting'), false) as ex from $rich)""",
    "featured": r"""
        select *, case when catalyst_type in ('new_listing', 'launchpool', 'megadrop') then 'listing' when catalyst_type = 'airdrop' then 'airdrop' when catalyst_type = 'delisting' then 'delisting' else '' end as narrative,
          case when regexp_matches(l, 'explod|surge|pump|blast|moon|🚀') then 'breakout_fomo' when regexp_matches(l, 'warning|crash|dump|plunge') then 'warning_alert' when regexp_matches(l, 'whale|smart money|accum|buying') then 'smart_money'
            when regexp_matches(l, 'listing|launchpool|airdrop|new on binance') then 'listing_news' when regexp_matches(l, 'ai|narrative|sector') then 'narrative_driven' when contains(l, '?') then 'question_hook'
            when regexp_matches(l, 'entry|target|setup') then 'trade_setup' else 'data_led' end as hook_style,
          case when regexp_matches(f, 'entry|enter') and regexp_matches(f, 'target|tp|🎯') and regexp_matches(f, 'stop|🛑|sl') then 'full_setup' when regexp_matches(f, 'entry|enter') and regexp_matches(f, 'target|tp|🎯') then 'entry_target'
            when regexp_matches(f, 'target|tp|🎯') then 'target_only' else 'analysis_only' end as setup_style,
          cast(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) as integer) as word_count, array_to_string(regexp_extract_all(content, '#[A-Za-z0-9_]+'), ',') as hashtags
        from (select *, lower(content) as f, lower(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], chr(10))) as l from v_post)""",
    "titled": "select ann_id, unnest(list_filter(['AI', 'AGENT', 'MEME', 'L1', 'L2', 'DeFi', 'RWA', 'GAMING', 'DePIN', 'INFRA', 'EXCHANGE', 'BTC', 'ETF', 'AIRDROP', 'LISTING'], lambda n: contains(lower(title), lower(n)))) as narrative from v_ann",
    "mentions": """
        select topic, 'announcement' as source, cast(row_number() over (order by n desc, topic) as integer) as rank, least(1e1, n * 2.5::double) as trend_strength, least(1e1, 5 + n * 1.5::double) as hot_search_score
        from (select topic, count(*) as n from (select narrative as topic from $titled union all select symbol from $named) group by topic)""",
    "searched": """
        select symbol as topic, 'search' as source, cast(ord + 1 as integer) as rank, greatest(1e0, 10 - search_score * 0.7::double) as trend_strength, least(1e1, greatest(1e0, 10 - search_score * 0.7::double)) as hot_search_score
        from (select row_number() over (order by volume_24h desc, pk) - 1 as ord, symbol, pk % 15 as search_score from $assets) where ord < 15""",
    "marketed": """
        select concat(symbol, '_SURGE') as topic, 'market' as source, cast(row_number() over (order by change_24h desc, ord) as integer) as rank, least(1e1, 5 + abs(change_24h) * 0.3::double) as trend_strength, least(1e1, 4 + abs(change_24h) * 0.3::double) as hot_search_score
        from (select * from $assets order by change_24h desc, ord limit 3) where change_24h > 3
        union all select concat(symbol, '_VOLUME'), 'market', cast(row_number() over (order by ord) + 10 as integer), least(1e1, 3 + volume_ratio * 2), least(1e1, 3 + volume_ratio * 1.5::double) from (select * from $assets where volume_ratio > 2 order by ord limit 3)""",
    "stand_ins": """
        select topic, 'synthetic' as source, cast(rank as integer) as rank, strength as trend_strength, strength as hot_search_score from (values ('AI', 1, 9e0), ('MEME', 2, 7.5e0), ('DeFi', 3, 7e0), ('L1', 4, 7.5e0), ('RWA', 5, 6.5e0), ('GAMING', 6, 6e0), ('DePIN', 7, 6e0), ('ETF', 8, 8e0), ('AIRDROP', 9, 7e0)) t(topic, rank, strength)""",
    "merged": """
        select topic, source, rank, trend_strength, hot_search_score from (select *, row_number() over (partition by lower(trim(topic)) order by list_position(['announcement', 'search', 'market', 'synthetic'], source), rank, topic) as i
          from (select * from $mentions union all select * from $searched union all select * from $marketed union all select * from $stand_ins)) where i = 1""",
    "points": """
        select symbol, list(close_px order by back desc) as points from (select *, row_number() over (partition by symbol order by ts desc, l_orderkey desc, l_linenumber desc) as back from v_tick) where back <= 5 group by symbol""",
    "flags": """
        select *, case when s < 3 and volume_ratio < 2 then 'EARLY' when s < 8 then 'FRESH' when s < 15 then 'ONGOING' else 'LATE' end as stage, case when category = '' then 'UNKNOWN' when category in ('AI', 'MEME', 'L1') then 'HIGH' when category in ('RWA', 'DePIN', 'GAMING') then 'GROWING' else 'STABLE' end as freshness,
      case when volume_ratio >= 3 then 'EXTREME' when volume_ratio >= 2 then 'HIGH' when volume_ratio >= 1.5 then 'ELEVATED' else 'NORMAL' end as volume_level, case when catalyst is not null or s > 5 then 'HIGH' when volume_ratio > 2 then 'MEDIUM' else 'LOW' end as interest,
      case when price > 0.1 and market_cap > 1e7 then 'YES' when price > 0.01 and market_cap > 1e6 then 'POSSIBLE' else 'NO' end as tradable, case when hours_ago is null then 'NEVER' when hours_ago < 24 then 'HIGH' when hours_ago < 48 then 'MEDIUM' else 'LOW' end as repetition,
      case when catalyst is not null then 'catalyst' when s > 8 then 'explosive' when s > 4 then 'strong' else 'gradual' end as move_detail, catalyst is null and volume_ratio > 2.5 as volume_confirms
    from (select *, abs(change_24h) as s from $rich)""",
    "patterns": """
        select symbol, case when up then 'bullish' when down then 'bearish' else 'neutral' end as trend, case when up then least(1e0, (p5 / p1 - 1) * 5) when down then least(1e0, abs(p5 / p1 - 1) * 3) else 5e-1 end as strength,
      case when not enough then '' when up then case when change_24h > 5 then 'breakout' else 'steady uptrend' end when down then case when change_24h < -5 then 'sharp selloff' else 'gradual distribution' end
        when abs(change_24h) < 2 then 'ranging' when change_24h > 0 then 'upward bias' else 'downward bias' end as pattern,
      case when not enough then 'medium' when list_max(points) / list_min(points) - 1 > 8e-2 then 'high' when list_max(points) / list_min(points) - 1 > 3e-2 then 'medium' else 'low' end as volatility
    from (select *, enough and p5 > p1 * 1.05::double as up, enough and p5 < p1 * 0.95::double as down from (select c.symbol, change_24h, points, points[1] as p1, points[-1] as p5, coalesce(len(points) >= 5, false) as enough from v_coin c left join $points p on p.symbol = c.symbol))""",
    "factors": """
        select *, case when len(f) > 0 then f else ['standard risk'] end as factors from (select *, list_filter([case when price < 0.1 then 'micro price' when price < 1 then 'low price' end, case when market_cap > 0 and market_cap < 1e7 then 'small cap' end,
          case when volume_ratio < 0.8 then 'thin volume' end, case when abs(change_24h) > 20 then 'extreme move' end, case when category = 'MEME' then 'meme asset' end], lambda x: x is not null) as f from $rich)""",
}


def expand(sql: str) -> str:
    """``sql`` with its $parts as common table expressions before it."""
    import re

    order: list[str] = []

    def need(s: str) -> None:
        for name in re.findall(r"\$(\w+)", s):
            if name not in order:
                need(PARTS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    heads = ", ".join(f"p_{n} as ({re.sub(r'[$](\w+)', r'p_\1', PARTS[n])})" for n in order)
    body = re.sub(r"\$(\w+)", r"p_\1", sql).strip()
    found = re.match(r"(?i)with (recursive )?", body)
    return f"with {found[1] or ''}{heads}, {body[found.end() :]}" if found else f"with {heads} {body}"


# Frames that several queries share.


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def assets(spark, sf) -> DataFrame:
    names = F.create_map(*[F.lit(x) for i, n in enumerate(("AI", "MEME", "L1", "RWA", "DeFi")) for x in (i, n)])
    return view(spark, sf, "v_coin").withColumns({
        "ord": F.col("pk"), "volume_ratio": filters.volume_ratio_market(F.col("volume_24h"), F.col("market_cap")), "category": F.coalesce(names[(F.col("pk") % 6).cast("int")], F.lit("")),
    })


def named(spark, sf) -> DataFrame:
    return lookup.mentions(view(spark, sf, "v_ann"), view(spark, sf, "v_symbol"))


def first_named(spark, sf) -> DataFrame:
    return lookup.first_mentions(view(spark, sf, "v_ann"), view(spark, sf, "v_symbol"))


def firsts(spark, sf) -> DataFrame:
    return first_named(spark, sf).groupBy("symbol").agg(F.min_by("ann_type", "ann_id").alias("catalyst"))


def ages(spark, sf) -> DataFrame:
    return history.hours_since(view(spark, sf, "v_post"), as_of())


def rich(spark, sf) -> DataFrame:
    return filters.enriched(assets(spark, sf), firsts(spark, sf), ages(spark, sf), view(spark, sf, "v_listed"))


def score_parts(spark, sf) -> DataFrame:
    feed = scoring.merge_feed(view(spark, sf, "v_rank"))
    return scoring.components(assets(spark, sf).join(feed, "symbol").withColumn("tagged", F.col("pk") % 3 == 0))


def scored(spark, sf) -> DataFrame:
    s = scoring.weighted_score(score_parts(spark, sf))
    return s.withColumn("decision", scoring.decision(F.col("score")))


def all_topics(spark, sf, *sources: str) -> DataFrame:
    """Topics of the providers that are asked for, of all if none is."""
    sources, out = sources or topics.PROVIDERS, []
    if "announcement" in sources:
        out.append(topics.from_announcements(lookup.narratives_in(view(spark, sf, "v_ann")), named(spark, sf)))
    if "search" in sources or "market" in sources:
        a = assets(spark, sf).select("pk", "ord", "symbol", "change_24h", "volume_24h", "volume_ratio")
        a = landing.written(a, "assets") if "market" in sources else a  # read several times
        place = F.row_number().over(filters.Window.orderBy(F.desc("volume_24h"), "pk")) - 1
        if "search" in sources:
            out.append(topics.from_search(a.orderBy(F.desc("volume_24h"), "pk").limit(15).select(place.alias("ord"), "symbol", (F.col("pk") % 15).alias("search_score"))))
        if "market" in sources:
            out.append(topics.from_market(a))
    if "synthetic" in sources:
        out.append(topics.standing(spark))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def featured(spark, sf) -> DataFrame:
    return reports.post_features(view(spark, sf, "v_post"))


# History.


@query("select id, upper(trim(symbol)) as symbol, created_at, catalyst_type from v_post where trim(symbol) <> ''")
def history_clean(spark, sf):
    posts = view(spark, sf, "v_post").select("id", F.col("symbol"), "created_at", "catalyst_type")
    return posts.withColumn("symbol", history.symbol_of("symbol")).where("symbol <> ''")


def _history_path(spark, sf) -> str:
    """Posts as lines of history files, some of them broken."""
    line = F.to_json(F.struct(
        F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("symbol"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.col("catalyst_type").alias("catalyst"), F.concat(F.lit("http://p/"), "id").alias("link"),
    ))
    broken = F.when(F.col("id") % 7 == 3, F.concat(F.lit("no json "), "id")).when(F.col("id") % 11 == 5, F.concat(F.lit('{"symbol": "'), "symbol")).when(F.col("id") % 13 == 8, F.lit('{"symbol": null}'))
    posts = view(spark, sf, "v_post").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return landing.land(posts.select(F.coalesce(broken, line).alias("value")), "history")


def _history_log(spark, sf) -> DataFrame:
    return feeds.read_history(spark, _history_path(spark, sf))


_BROKEN = "(id % 7 = 3 or id % 11 = 5 or id % 13 = 8)"


@query(f"select symbol, created_at, catalyst_type as catalyst, concat('http://p/', cast(id as varchar)) as link from v_post where not {_BROKEN}")
def history_lines(spark, sf):
    return history.clean_history(_history_log(spark, sf)).select("symbol", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "catalyst", "link")


@query(f"select count_if(not {_BROKEN}) as n_valid, count_if({_BROKEN}) as n_corrupt from v_post")
def history_audit(spark, sf):
    """The counts that come with writing the clean lines."""
    seen = history.write_clean(_history_log(spark, sf), f"{landing.landing_dir(spark)}/clean")
    return spark.createDataFrame([(seen["n_valid"], seen["n_corrupt"])], "n_valid long, n_corrupt long")


@query("select symbol, count(*) as n, max(created_at) as last_at from v_post group by symbol")
def history_append(spark, sf):
    """Posts added to a log in two writes, and read again."""
    posts = view(spark, sf, "v_post").select(
        "id", "symbol", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), F.col("catalyst_type").alias("catalyst"), F.lit("x").alias("link"),
        F.lit(None).cast("string").alias("image_url"), F.lit("m").alias("media_id"),
    )
    path = f"{landing.landing_dir(spark)}/log"
    for part in (posts.where("id % 3 = 0"), posts.where("id % 3 <> 0")):
        feeds.append_history(part, path)
    kept = history.clean_history(feeds.read_history(spark, path))
    return kept.groupBy("symbol").agg(F.count("*").alias("n"), F.max("created_at").cast("timestamp_ntz").alias("last_at"))


@query("""
    select symbol, coalesce(not (catalyst in ('new_listing', 'launchpool', 'megadrop', 'airdrop', 'delisting')) and hours_ago < 24, false) as blocked
    from (select symbol, coalesce(catalyst, 'market_move') as catalyst, hours_ago from $rich)""")
def cooldown_flags(spark, sf):
    flag = history.blocked(F.coalesce("catalyst", F.lit("market_move")), F.col("hours_ago"))
    return rich(spark, sf).select("symbol", F.coalesce(flag, F.lit(False)).alias("blocked"))


@query(r"""
    select symbol, regexp_replace(regexp_replace(cast(cast(pk / 8 as decimal(38, 6)) as varchar), '0+$', ''), '\.$', '') as plain,
      case when pk % 2 = 0 then concat(chr(36), format('{:,.1f}', (pk + 10) / 10), 'B') else concat(chr(36), format('{:,.1f}', (pk % 9000 + 10) / 10), 'M') end as cap, case when pk / 16 < 100 then format('{:,.4f}', pk / 16) else format('{:,.2f}', pk // 1 * 1e0) end as price
    from v_coin""")
def shown_numbers(spark, sf):
    pk = F.col("pk")
    cap = F.when(pk % 2 == 0, (pk + 10) * 1e8).otherwise((pk % 9000 + 10) * 1e5)
    price = F.when(pk / 16 < 100, pk / 16).otherwise(pk.cast("double"))
    return view(spark, sf, "v_coin").select("symbol", text.plain_number(pk / 8).alias("plain"), text.compact_cap(cap).alias("cap"), text.shown_price(price).alias("price"))


@query(f"select id, symbol, created_at, image_url from (select id, symbol, created_at, case when id % 2 = 0 then '' else concat('img/', cast(id as varchar)) end as image_url from v_post)")
def history_reconciled(spark, sf):
    posts = view(spark, sf, "v_post").select("id", "symbol", "created_at")
    new = posts.where("id % 2 <> 0").withColumn("image_url", F.concat(F.lit("img/"), F.col("id").cast("string")))
    return feeds.reconciled(posts.where("id % 2 = 0"), new)


@query("select * from $ages")
def hours_since_post(spark, sf):
    return ages(spark, sf)


@query("select symbol, min(h) as hours_ago from (select symbol, hours_ago as h from $ages union all select symbol, cast(pk % 72 as double) from v_coin) group by symbol")
def cooldown_merge(spark, sf):
    other = view(spark, sf, "v_coin").select("symbol", (F.col("pk") % 72).cast("double").alias("hours_ago"))
    return history.merge_ages(ages(spark, sf), other)


@query(f"""
    select symbol, hours_ago, hours_ago < 24 as blocked from (select symbol, (epoch_us(timestamp '{AS_OF}') - epoch_us(max(created_at))) / 3.6e9 as hours_ago from (select * from v_post order by id desc limit 50) group by symbol)""")
def cooldown_tail(spark, sf):
    return history.cooldown_tail(view(spark, sf, "v_post"), as_of())


@query("select id, symbol, (epoch_us(created_at) - epoch_us(before)) / 3.6e9 as gap_hours from (select *, lag(created_at) over (partition by symbol order by created_at, id) as before from v_post) where before is not null")
def repost_gaps(spark, sf):
    return history.gaps(view(spark, sf, "v_post"))


@query("select distinct symbol from (select * from v_post order by id desc limit 100)")
def recent_symbols(spark, sf):
    return history.newest(view(spark, sf, "v_post"), 100).select("symbol").distinct()


@query("select symbol, count(*) as n_posts from v_post group by symbol")
def symbol_counts(spark, sf):
    return view(spark, sf, "v_post").groupBy("symbol").agg(F.count("*").alias("n_posts"))


@query("select strftime(created_at, '%Y-%m-%d') as day, count(*) as n_posts, cast(greatest(8 - count(*), 0) as bigint) as remaining from v_post group by 1")
def daily_cap(spark, sf):
    return history.daily_cap(view(spark, sf, "v_post")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("select id, symbol from (select *, row_number() over (partition by cast(created_at as date) order by created_at, id) as i from v_post) where i <= 8")
def daily_admission(spark, sf):
    return history.within_cap(view(spark, sf, "v_post")).select("id", "symbol")


@query("select id, symbol, catalyst_type as catalyst from v_post order by id desc limit 100")
def recent_posts(spark, sf):
    posts = view(spark, sf, "v_post").withColumn("metadata", F.to_json(F.struct(F.col("catalyst_type").alias("catalyst"))))
    return history.recent_with_metadata(posts).select("id", "symbol", F.col("metadata")["catalyst"].alias("catalyst"))


@query("""
    with recursive p as (select id, symbol, created_at from v_post), a as (
      select id, symbol, created_at from (select *, row_number() over (partition by symbol order by created_at, id) as i from p) where i = 1
      union all select id, symbol, created_at from (
        select p.*, row_number() over (partition by p.symbol order by p.created_at, p.id) as i from a join p on p.symbol = a.symbol and p.created_at >= a.created_at + interval 24 hour) where i = 1)
    select id, symbol from a""")
def sequential_admission(spark, sf):
    return history.sequential_cooldown(view(spark, sf, "v_post")).select("id", "symbol")


# Universe.


@query("select distinct symbol from v_listed")
def listed_assets(spark, sf):
    return view(spark, sf, "v_listed").distinct()


@query("select pk, symbol from v_coin where symbol in (select symbol from v_listed)")
def listed_semi(spark, sf):
    return view(spark, sf, "v_coin").join(view(spark, sf, "v_listed"), "symbol", "left_semi").select("pk", "symbol")


@query("select pk, symbol from v_coin where symbol not in (select symbol from v_listed)")
def unlisted_anti(spark, sf):
    return view(spark, sf, "v_coin").join(view(spark, sf, "v_listed"), "symbol", "left_anti").select("pk", "symbol")


@query("select pk, symbol, price, market_cap from v_coin where price > 0 and market_cap >= 1e6 and abs(change_24h) <= 100 and symbol in (select symbol from v_listed)")
def universe_filtered(spark, sf):
    return filters.universe(view(spark, sf, "v_coin"), view(spark, sf, "v_listed")).select("pk", "symbol", "price", "market_cap")


@query("select symbol, price, change_24h, volume_24h, greatest(1e0, pk / 1000) as volume_ratio, greatest(volume_24h * 10, price * 1e6) as market_cap from v_coin where pk % 2 = 0 and price > 0 order by volume_24h desc, concat(symbol, 'USDT') limit 12")
def ticker_universe(spark, sf):
    pairs = view(spark, sf, "v_coin").select(F.concat("symbol", F.when(F.col("pk") % 2 == 0, "USDT").otherwise("EUR")).alias("symbol"), "price", "change_24h", "volume_24h", F.col("pk").alias("trades"))
    return filters.quote_tickers(pairs)


@query("select symbol, volume_ratio as ratio_market, case when market_cap > 0 then least(volume_24h / greatest(market_cap, 1e0) * 5, 5e0) else 1e0 end as ratio_rank from $assets")
def volume_ratio(spark, sf):
    return assets(spark, sf).select("symbol", F.col("volume_ratio").alias("ratio_market"), filters.volume_ratio_rank(F.col("volume_24h"), F.col("market_cap")).alias("ratio_rank"))


@query("select symbol, volume_ratio from $assets where volume_ratio >= 1.75")
def volume_spikes(spark, sf):
    return filters.volume_spikes(assets(spark, sf)).select("symbol", "volume_ratio")


def _extreme(sign: str):
    return f"select risk_level, symbol, change_24h, cast(rank as integer) as rank from (select *, row_number() over (partition by risk_level order by change_24h {sign}, pk) as rank from v_coin) where rank <= 3"


@query(_extreme("desc"))
def top_gainers(spark, sf):
    return filters.top_by(view(spark, sf, "v_coin"), "risk_level", 3, F.desc("change_24h"), F.col("pk")).select("risk_level", "symbol", "change_24h", "rank")


@query(_extreme("asc"))
def top_losers(spark, sf):
    return filters.top_by(view(spark, sf, "v_coin"), "risk_level", 3, F.asc("change_24h"), F.col("pk")).select("risk_level", "symbol", "change_24h", "rank")


@query("select pk, symbol, risk_level from v_coin where risk_level = 1 and liquidity > 0 union all select pk, symbol, risk_level from v_coin where risk_level > 1 and market_cap > 0")
def fallback_source(spark, sf):
    coins = view(spark, sf, "v_coin")
    return feeds.else_fallback(coins.where("risk_level = 1 and liquidity > 0").select("pk", "symbol", "risk_level"), coins.where("risk_level = 1 or market_cap > 0").select("pk", "symbol", "risk_level"), "risk_level")


# The reject cascade.


def _reasons(spark, sf) -> DataFrame:
    return rich(spark, sf).withColumn("reason", filters.reject_reason(top=("P1", "P2", "P3", "P4", "P5")))


@query("select symbol, reason from $reasons where reason is not null")
def reject_reasons(spark, sf):
    return _reasons(spark, sf).where("reason is not null").select("symbol", "reason")


@query("select symbol, case when symbol = '' then 'empty symbol' when price <= 0 or price < 1e-2 then 'price too low' when market_cap > 0 and market_cap < 5e5 then 'market cap too low' end as reason from $rich where price <= 0 or price < 1e-2 or (market_cap > 0 and market_cap < 5e5)")
def strict_rejects(spark, sf):
    """The thresholds of assets that don't come from the hub, where they decide."""
    rows = rich(spark, sf).withColumn("reason", filters.reject_reason(from_hub=False, top=("P1", "P2", "P3", "P4", "P5")))
    return rows.where(F.col("reason").isin("empty symbol", "price too low", "market cap too low")).select("symbol", "reason")


@query("select symbol from $reasons where reason is null")
def candidates(spark, sf):
    return _reasons(spark, sf).where("reason is null").select("symbol")


@query("select pk, symbol, g from (select *, count(*) over (partition by g) as n from (select r.symbol, c.pk, c.pk % 250 as g from $reasons r join v_coin c on c.symbol = r.symbol where reason is null)) where n >= 3")
def min_group_gate(spark, sf):
    rows = _reasons(spark, sf).where("reason is null").select("pk", "symbol", (F.col("pk") % 250).alias("g"))
    return filters.large_groups(rows, "g", 3).select("pk", "symbol", "g")


@query("select coalesce(reason, 'passed') as outcome, count(*) as n from $reasons group by 1")
def scan_funnel(spark, sf):
    """The counts that come with writing the candidates."""
    seen = filters.write_candidates(rich(spark, sf), f"{landing.landing_dir(spark)}/candidates", top=("P1", "P2", "P3", "P4", "P5"))
    return spark.createDataFrame(list(seen.items()), "outcome string, n long")


# Scores.


@query("""
    select symbol, price, volume_24h, market_cap, case when market_cap > 0 then least(volume_24h / greatest(market_cap, 1e0) * 5, 5e0) else 1e0 end as volume_ratio, array_to_string(sources, ',') as sources, cast(n_entries as integer) as n_entries, cast(n_sources as integer) as n_sources
    from (select r.symbol, arg_min(c.price * r.rank_type, (rank_type, chain_id)) as price, arg_min(c.volume_24h + r.rank_type, (rank_type, chain_id)) as volume_24h, arg_min(c.market_cap, (rank_type, chain_id)) as market_cap,
      list(source order by rank_type, chain_id) as sources, count(*) as n_entries, count(distinct source) as n_sources from v_rank r join v_coin c on c.symbol = r.symbol group by r.symbol)""")
def rank_feed_merge(spark, sf):
    coins = view(spark, sf, "v_coin").select("symbol", "price", "volume_24h", "market_cap")
    rows = view(spark, sf, "v_rank").join(coins, "symbol").withColumns({"price": F.col("price") * F.col("rank_type"), "volume_24h": F.col("volume_24h") + F.col("rank_type")})
    merged = scoring.merge_feed(rows, "price", "volume_24h", "market_cap").withColumn("sources", F.array_join("sources", ","))
    return merged.withColumn("volume_ratio", filters.volume_ratio_rank(F.col("volume_24h"), F.col("market_cap")))


@query("select rank_type, chain_id, symbol, cast(row_number() over (partition by rank_type, chain_id order by pk) as integer) as position from v_rank")
def feed_rank(spark, sf):
    return scoring.feed_positions(view(spark, sf, "v_rank"), "pk").select("rank_type", "chain_id", "symbol", "position")


@query("select symbol, c_trending, c_smart_money, c_top_search, c_volume, c_market_cap, c_liquidity, c_momentum, c_quality, a_smart_money, a_volume, a_market_cap, a_liquidity from $parts")
def score_components(spark, sf):
    return score_parts(spark, sf).select("symbol", *[f"c_{k}" for k in scoring.WEIGHTS], *[f"a_{k}" for k in ("smart_money", "volume", "market_cap", "liquidity")])


@query("select symbol, score from $scored")
def asset_scores(spark, sf):
    return scored(spark, sf).select("symbol", "score")


@query("select decision, count(*) as n from $scored group by decision")
def score_gate(spark, sf):
    return scored(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query("select symbol, least(abs(change_24h) * 3 + volume_ratio * 10, 1e2) as score from $assets")
def heuristic_score(spark, sf):
    return assets(spark, sf).select("symbol", scoring.heuristic_score(F.col("change_24h"), F.col("volume_ratio")).alias("score"))


@query("""
    select symbol, greatest(least(greatest(change_24h, -5e0), 5e0) * 3e-1 + least(5e0, volume_ratio * 1.5e0) * 3e-1 + least(3e0, market_cap / 1e11) * 2e-1 + (abs(change_24h) / 10 + volume_ratio / 2) * 2e-1
      + case category when 'AI' then 2e0 when 'MEME' then 1.5e0 when 'L1' then 1e0 else 0e0 end, 0e0) as score from $assets""")
def priority_score(spark, sf):
    return assets(spark, sf).select("symbol", scoring.priority_score(F.col("change_24h"), F.col("volume_ratio"), F.col("market_cap"), F.col("category")).alias("score"))


@query("select symbol, least(greatest(change_24h, -1e1), 1e1) + least(1e1, volume_ratio * 3) - case when market_cap <= 0 then 2e0 else 0e0 end as score from $assets")
def momentum_score(spark, sf):
    return assets(spark, sf).select("symbol", scoring.momentum_score(F.col("change_24h"), F.col("volume_ratio"), F.col("market_cap")).alias("score"))


_ROUTED = """
    with s as (select s.symbol, s.pk % 20 as g, score, decision, hours_ago from $scored s left join $ages a on a.symbol = s.symbol where decision <> 'reject'),
    r as (select *, row_number() over (partition by g, decision order by score desc, symbol) as place from s),
    direct as (select *, 1 as rank from r where decision = 'direct' and place = 1),
    review as (select *, row_number() over (partition by g order by place) as rank from r where decision = 'review' and place <= 5 and (hours_ago is null or hours_ago >= 24) and g not in (select g from direct))
    select g, symbol, score, decision, cast(rank as integer) as rank from direct union all select g, symbol, score, decision, cast(rank as integer) from review where rank <= 3"""


@query(_ROUTED)
def route_candidates(spark, sf):
    s = scored(spark, sf).select("symbol", (F.col("pk") % 20).alias("g"), "score", "decision").join(ages(spark, sf), "symbol", "left")
    return routing.route(s, "g").select("g", "symbol", "score", "decision", "rank")


@query("""
    select g, symbol, cast(row_number() over (partition by g order by case when picked then 0 else 1 end, score desc, symbol) as integer) as rank, case when picked then 'publish' else 'skip' end as verdict
    from (select *, pk % 20 as g, pk % 140 < 20 as picked from $scored)""")
def rank_reasons(spark, sf):
    s = scored(spark, sf).withColumn("g", F.col("pk") % 20)
    return routing.ranking_list(s, "g", F.col("pk") % 140 < 20).select("g", "symbol", "rank", "verdict")


@query("""
    with p as (select risk_level as g, symbol, pk as package_id from v_coin where liquidity > 0)
    select c.risk_level as g, lower(c.symbol) as symbol, coalesce(p.package_id, f.package_id) as package_id from v_coin c
      left join p on p.g = c.risk_level and p.symbol = c.symbol left join (select g, min(package_id) as package_id from p group by g) f on f.g = c.risk_level""")
def pick_match(spark, sf):
    c = view(spark, sf, "v_coin").select(F.col("risk_level").alias("g"), "symbol", "pk", "liquidity")
    return routing.match_pick(c.withColumn("symbol", F.lower("symbol")), c.where("liquidity > 0").withColumnRenamed("pk", "package_id"), "g")


# Announcements.


@query("select ann_id, ann_type, released_at, case when ann_type = 'news' then 'medium' else 'high' end as impact from (select *, row_number() over (partition by ann_type order by released_at desc, ann_id desc) as i from v_ann) where i <= 5")
def announcements_recent(spark, sf):
    last = filters.top_by(view(spark, sf, "v_ann"), "ann_type", 5, F.desc("released_at"), F.desc("ann_id"))
    return last.select("ann_id", "ann_type", "released_at", F.when(F.col("ann_type") == "news", "medium").otherwise("high").alias("impact"))


@query("select ann_id, symbol from $named")
def title_symbols(spark, sf):
    return named(spark, sf).select("ann_id", "symbol")


@query("select c.pk, c.symbol, f.ann_id, coalesce(f.catalyst, 'market_move') as catalyst from v_coin c left join $firsts f on f.symbol = c.symbol")
def first_announcement(spark, sf):
    return lookup.first_announcement(view(spark, sf, "v_coin").select("pk", "symbol"), first_named(spark, sf))


@query("""
    select symbol, ann_id, ann_type as catalyst, cast(priority as integer) as priority from (select *, row_number() over (partition by symbol order by priority desc, ann_id) as i from (
      select *, case ann_type when 'new_listing' then 10 when 'launchpool' then 9 when 'megadrop' then 9 when 'airdrop' then 8 when 'delisting' then 6 when 'news' then 3 else 0 end as priority from $named)) where i = 1""")
def strongest_catalyst(spark, sf):
    return lookup.strongest_catalyst(first_named(spark, sf))


@query("select ann_id, narrative from $titled")
def title_narratives(spark, sf):
    return lookup.narratives_in(view(spark, sf, "v_ann"))


@query("select p.id, s.symbol from v_post p join v_symbol s on contains(lower(p.content), lower(s.symbol))")
def post_names(spark, sf):
    """Which known names stand anywhere in a post, case aside; names are a table."""
    found = lookup.found_in(view(spark, sf, "v_post").select("id", F.col("content").alias("text")), view(spark, sf, "v_symbol").select(F.col("symbol").alias("name")), any_case=True)
    return found.select("id", F.col("name").alias("symbol"))


# Topics.


@query("select * from $mentions")
def topics_announcement(spark, sf):
    return all_topics(spark, sf, "announcement")


@query("select * from $searched")
def topics_search(spark, sf):
    return all_topics(spark, sf, "search")


@query("select * from $marketed")
def topics_market(spark, sf):
    return all_topics(spark, sf, "market")


@query("select * from $merged")
def topics_merged(spark, sf):
    return topics.merge(all_topics(spark, sf))


_TOPIC_NAMES = "select distinct p_brand as topic from part union select distinct concat(p_type, ' X') from part union select distinct concat('T', cast(p_size as string)) from part union select distinct concat('  ', substring(p_name, 1, 4), ' ') from part union select 'no such topic'"


def _topic_names(spark, sf) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    return spark.sql(_TOPIC_NAMES.replace("from part", "from {part}"), part=part)


def _dimension(spark, sf) -> DataFrame:
    return view(spark, sf, "v_topic_dim")


_TOPIC_COINS = f"""
    with t as ({_TOPIC_NAMES}), e as (select upper(topic) as entry, min(ord) as ord, list_sort(list(distinct symbol)) as a from v_topic_dim group by 1),
    m as (select t.topic, e.a, row_number() over (partition by t.topic order by case when upper(trim(t.topic)) = entry then 0 else 1 end, ord, entry) as i from t join e on contains(upper(trim(t.topic)), entry) or contains(entry, upper(trim(t.topic))))
    select t.topic, cast(len(a) as integer) as n_assets, array_to_string(a, ',') as assets from (select t.topic, coalesce(m.a, case when regexp_full_match(upper(trim(t.topic)), '[A-Z]{{2,10}}') then [upper(trim(t.topic))] else [] end) as a
      from t left join (select * from m where i = 1) m on m.topic = t.topic) t"""


@query(_TOPIC_COINS)
def topic_coins(spark, sf):
    found = lookup.assets_of_topics(_topic_names(spark, sf), _dimension(spark, sf))
    return found.select("topic", F.size("assets").alias("n_assets"), F.array_join("assets", ",").alias("assets"))


@query("select c.symbol, coalesce(d.topic, 'GENERAL') as narrative from v_coin c left join (select symbol, arg_min(topic, ord) as topic from v_topic_dim where ord > 100 group by symbol) d on d.symbol = c.symbol")
def narrative_lookup(spark, sf):
    dim = _dimension(spark, sf).where("ord > 100")
    return lookup.first_entry(view(spark, sf, "v_coin").select("symbol"), dim, "topic", "GENERAL").select("symbol", F.col("entry").alias("narrative"))


@query("select c.symbol, coalesce(d.topic, '') as category from v_coin c left join (select symbol, arg_min(topic, ord) as topic from v_topic_dim group by symbol) d on d.symbol = c.symbol")
def category_lookup(spark, sf):
    return lookup.first_entry(view(spark, sf, "v_coin").select("symbol"), _dimension(spark, sf), "topic", "").select("symbol", F.col("entry").alias("category"))


_TOPIC_SCORES = "select topic, symbol, ord, least(1e1, 4 + ord * 3e-1) as hot from v_topic_dim"


@query(f"select c.symbol, coalesce(h.hot, 0e0) as hot_score from v_coin c left join (select symbol, max(hot) as hot from ({_TOPIC_SCORES}) group by symbol) h on h.symbol = c.symbol")
def hot_score(spark, sf):
    dim = _dimension(spark, sf).groupBy("topic", "ord").agg(F.collect_list("symbol").alias("assets")).withColumn("hot_search_score", F.least(F.lit(10.0), 4 + F.col("ord") * 0.3))
    return lookup.hot_score(view(spark, sf, "v_coin"), dim)


@query("""
    select * from (select topic, source, rank from $merged where source <> 'synthetic' or not exists (select 1 from $merged where source <> 'synthetic')
      order by rank, list_position(['announcement', 'search', 'market', 'synthetic'], source), topic limit 10)""")
def top_trending(spark, sf):
    return topics.top_trending(topics.merge(all_topics(spark, sf)), 10).select("topic", "source", "rank")


@query("select p.source, coalesce(n, 0) as n_topics, n is not null as active from (values ('announcement'), ('search'), ('market'), ('synthetic')) p(source) left join (select source, count(*) as n from (select * from $mentions union all select * from $searched union all select * from $marketed union all select * from $stand_ins) group by source) t on t.source = p.source")
def provider_status(spark, sf):
    return topics.provider_status(all_topics(spark, sf))


@query("""
    with t as (select topic, rank, trend_strength from $merged), e as (select upper(topic) as entry, min(ord) as ord, list_sort(list(distinct symbol)) as a from v_topic_dim group by 1),
    m as (select t.topic, e.a, row_number() over (partition by t.topic order by case when upper(trim(t.topic)) = entry then 0 else 1 end, ord, entry) as i from t join e on contains(upper(trim(t.topic)), entry) or contains(entry, upper(trim(t.topic)))),
    f as (select t.*, coalesce(m.a, case when regexp_full_match(upper(trim(t.topic)), '[A-Z]{2,10}') then [upper(trim(t.topic))] else [] end) as a from t left join (select * from m where i = 1) m on m.topic = t.topic)
    select string_agg(concat(topic, ':', cast(cast(floor(trend_strength + 5e-1) as bigint) as varchar), '/10', case when len(a) > 0 then concat(' (', array_to_string(list_transform(a[1:3], lambda x: concat(chr(36), x)), ', '), ')') else '' end), ' | ' order by rank, topic) as summary
    from (select * from f order by rank, topic limit 5)""")
def narrative_summary(spark, sf):
    t = topics.merge(all_topics(spark, sf))
    return topics.summary(lookup.assets_of_topics(t, _dimension(spark, sf)))


# Reports.


@query("select catalyst_type, count(*) as n_posts, avg(views) as avg_views from v_post group by 1 order by 2 desc, 1 limit 5")
def catalyst_usage(spark, sf):
    return reports.usage(view(spark, sf, "v_post"), "catalyst_type")


@query("select narrative, count(*) as n_posts from $featured where narrative <> '' group by 1 order by 2 desc, 1 limit 5")
def narrative_counts(spark, sf):
    return reports.counts(featured(spark, sf), "narrative")


@query("select hook_style, count(*) as n_posts from $featured group by 1 order by 2 desc, 1 limit 5")
def hook_counts(spark, sf):
    return reports.counts(featured(spark, sf), "hook_style")


@query("select avg(word_count) as avg_words from $featured")
def avg_words(spark, sf):
    return featured(spark, sf).agg(F.avg("word_count").alias("avg_words"))


@query("select cast(hour(created_at) as integer) as hour, count(*) as n_posts from v_post group by 1 order by 2 desc, 1 limit 3")
def posting_hours(spark, sf):
    return reports.posting_hours(view(spark, sf, "v_post"))


@query("select * from (select symbol, avg(views) as avg_views, count(*) as n_posts from v_post group by 1 order by 2 desc nulls last, 1 limit 10) where avg_views is not null")
def top_performers(spark, sf):
    return reports.top_performers(view(spark, sf, "v_post"))


@query("select p.id, p.symbol, m.id as metric_id, coalesce(m.views, 0) + 5 * coalesce(m.traders, 0) as engagement from v_post p join v_post m on m.id = p.id order by engagement desc, metric_id limit 20")
def engagement_top(spark, sf):
    posts = view(spark, sf, "v_post")
    metrics = posts.select(F.col("id").alias("metric_id"), F.col("id").alias("post_id"), F.col("views").alias("m_views"), F.col("traders").alias("m_traders"))
    return reports.top_engagement(posts.select("id", "symbol"), metrics)


@query("""
    select * from (select 'catalyst' as section, catalyst_type as key, count(*) as n, avg(views) as value from v_post group by 2 order by 3 desc, 2 limit 5)
    union all select * from (select 'narrative', narrative, count(*), cast(null as double) from $featured where narrative <> '' group by 2 order by 3 desc, 2 limit 5)
    union all select * from (select 'hook', hook_style, count(*), cast(null as double) from $featured group by 2 order by 3 desc, 2 limit 5)
    union all select 'words', 'all', count(*), avg(word_count) from $featured
    union all select * from (select 'hour', cast(hour(created_at) as varchar), count(*), cast(null as double) from v_post group by hour(created_at) order by count(*) desc, hour(created_at) limit 3)""")
def insights(spark, sf):
    return reports.insights(featured(spark, sf))


@query("""
    with b as (select *, id % 50 as likes, case when id % 5 = 0 then null else id % 9 end as comments, cast(null as bigint) as shares, case when id % 6 = 0 then null else value_of end as reward from (select *, cast(id % 1000 as double) / 8 as value_of from v_post)),
    t as (select symbol, arg_max(id, (created_at, id)) as id from v_post where views is null group by symbol),
    u as (select t.id, c.pk * 10 as v, case when c.pk % 2 = 0 then c.pk end as tr, case when c.pk % 3 = 0 then c.pk + 1 end as co, c.pk % 4 as sh, case when c.pk % 5 = 0 then c.change_24h end as re from t join v_coin c on c.symbol = t.symbol)
    select b.id, b.symbol, coalesce(u.v, b.views) as views, coalesce(u.tr, b.traders) as traders, b.likes, coalesce(u.co, b.comments) as comments, coalesce(u.sh, b.shares) as shares, coalesce(u.re, b.reward) as reward from b left join u on u.id = b.id""")
def metrics_upsert(spark, sf):
    i, pk = F.col("id"), F.col("pk")
    posts = view(spark, sf, "v_post").withColumns({
        "likes": i % 50, "comments": F.when(i % 5 != 0, i % 9), "shares": F.lit(None).cast("long"), "reward": F.when(i % 6 != 0, (i % 1000).cast("double") / 8),
    })
    updates = view(spark, sf, "v_coin").select(
        F.lower("symbol").alias("symbol"), (pk * 10).alias("new_views"), F.when(pk % 2 == 0, pk).alias("new_traders"), F.when(pk % 3 == 0, pk + 1).alias("new_comments"), (pk % 4).alias("new_shares"), F.when(pk % 5 == 0, F.col("change_24h")).alias("new_reward"),
    )
    return reports.upsert_metrics(posts, updates).select("id", "symbol", "views", "traders", "likes", "comments", "shares", "reward")


# Post text.


@query("select id, narrative, hook_style, setup_style, word_count, hashtags from $featured")
def post_features(spark, sf):
    return featured(spark, sf).select("id", "narrative", "hook_style", "setup_style", "word_count", "hashtags")


@query(r"""
    select id, array_to_string(list_filter([case when len(t) = 0 then 'no cashtag' end, case when len(t) > 0 and not list_contains(t, '$' || symbol) then 'own cashtag missing' end,
      case when len(h) < 3 then 'too few hashtags' end, case when n < 50 then 'too short' end], lambda x: x is not null), ',') as issues
    from (select id, symbol, regexp_extract_all(content, '\$[A-Za-z0-9_]+') as t, regexp_extract_all(content, '#[A-Za-z0-9_]+') as h, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) as n from v_post)""".replace("'$' ||", "chr(36) ||").replace(r"'\$[", r"'\x24["))
def quality_issues(spark, sf):
    return reports.quality_issues(view(spark, sf, "v_post")).select("id", F.array_join("issues", ",").alias("issues"))


@query(r"""
    select id, case when len(h) > 5 then concat(trim(regexp_replace(regexp_replace(content, '#[A-Za-z0-9_]+', '', 'g'), ' +', ' ', 'g')), chr(10), array_to_string(h[1:5], ' ')) else content end as content
    from (select id, content, regexp_extract_all(content, '#[A-Za-z0-9_]+') as h from v_post)""")
def limit_hashtags(spark, sf):
    return view(spark, sf, "v_post").select("id", text.limited_hashtags(F.col("content")).alias("content"))


@query("select substring(sha256(concat_ws('|', symbol, catalyst_type, coalesce(cast(views as varchar), ''))), 1, 16) as signature, min(id) as first_id, count(*) as n_posts from v_post group by 1")
def signature_dedup(spark, sf):
    return reports.signature_dedup(view(spark, sf, "v_post").withColumn("views", F.col("views").cast("string")), "symbol", "catalyst_type", "views")


@query("""
    select id as resp_id, 1 as place, cast(1 as integer) as rank, symbol, concat(catalyst_type, ': ', coalesce(cast(views as varchar), 'unknown')) as reason from v_post
    union all select id, 2, 2, '', concat('none named by ', cast(id as varchar)) from v_post
    union all select id, 3, cast(3 + abs(traders) % 4 as integer), concat('Q', cast(abs(traders) as varchar)), 'traders' from v_post where traders is not null""")
def rank_extract(spark, sf):
    third = F.when(F.col("traders").isNotNull(), F.concat(F.lit("\nRANK: "), 3 + F.abs("traders") % 4, F.lit("\nCOIN: q"), F.abs("traders"), F.lit("\nREASON: traders"))).otherwise("")
    said = F.concat(
        F.lit("Here it is\nRANK: 2\nREASON: none named by "), F.col("id").cast("string"), F.lit("\nRANK: x\nCOIN: $BAD\nRANK: 1\nREASON: old\nCOIN: $"), F.lower("symbol"),
        F.lit("\nREASON: "), F.col("catalyst_type"), F.lit(": "), F.coalesce(F.col("views").cast("string"), F.lit("unknown")), third,
    )
    return reports.parse_rankings(view(spark, sf, "v_post").select(F.col("id").alias("resp_id"), said.alias("text")))


@query("select id, substring(content, 1, 20) as short, substring(content, 1, 60) as middle, substring(coalesce(cast(views as varchar), ''), 1, 2) as digits from v_post")
def post_snippets(spark, sf):
    return view(spark, sf, "v_post").select("id", text.clipped(F.col("content"), 20).alias("short"), text.clipped(F.col("content"), 60).alias("middle"), text.clipped(F.col("views").cast("string"), 2).alias("digits"))


# Prices and research columns.


def patterned(spark, sf) -> DataFrame:
    return research.price_pattern(rich(spark, sf).join(research.recent_points(view(spark, sf, "v_tick"), 5), "symbol", "left"))


@query("select symbol, trend, strength, pattern, volatility from $patterns")
def price_pattern(spark, sf):
    return patterned(spark, sf).select("symbol", "trend", "strength", "pattern", "volatility")


@query("""
    select t.symbol, l_orderkey, l_linenumber, (close_px - low) / case when high > low then high - low else 1e0 end as scaled, case when nxt is null then 'last' when nxt >= close_px then 'up' else 'down' end as step
    from (select *, lead(close_px) over (partition by symbol order by ts, l_orderkey, l_linenumber) as nxt from v_tick) t join (select symbol, min(close_px) as low, max(close_px) as high from v_tick group by symbol) s on s.symbol = t.symbol""")
def series_scaled(spark, sf):
    return research.scaled_series(view(spark, sf, "v_tick"))


@query("""
    select symbol, i, case when flat then price else start + (price - start) * i / 9 end as point from (select symbol, price, unnest(range(0, 10)) as i, abs(change_24h) < 0.01 or 1 + change_24h / 100 <= 0 as flat, case when 1 + change_24h / 100 <> 0 then price / (1 + change_24h / 100) else price end as start from v_coin)""")
def linear_history(spark, sf):
    line = research.linear_history(F.col("price"), F.col("change_24h"))
    return view(spark, sf, "v_coin").select("symbol", F.posexplode(line).alias("i", "point")).withColumn("i", F.col("i").cast("long"))


@query("select symbol, price * 1.002::double as entry, price * 1.08::double as target1, price * 1.16::double as target2, price * 0.94::double as stop from v_coin")
def trade_levels(spark, sf):
    return view(spark, sf, "v_coin").select("symbol", *[v.alias(k) for k, v in research.trade_levels(F.col("price")).items()])


@query("select symbol, case when volume_ratio > 2 then 'exceptional' when volume_ratio > 1.5 then 'above average' when volume_ratio < 0.5 then 'very thin' when volume_ratio < 1 then 'below average' else 'normal' end as verdict, market_cap > 0 and case when market_cap <> 0 then volume_24h / market_cap else 0e0 end < 0.01 as thin from $assets")
def volume_verdict(spark, sf):
    return assets(spark, sf).select("symbol", research.volume_verdict(F.col("volume_ratio")).alias("verdict"), research.thin_market(F.col("volume_24h"), F.col("market_cap")).alias("thin"))


@query("select symbol, array_to_string(factors, ',') as factors, case when len(factors) + case when price < 0.1 then 1 else 0 end + case when abs(change_24h) > 15 then 1 else 0 end >= 3 then 'high' else 'medium' end as level from $factors")
def risk_assessment(spark, sf):
    a = assets(spark, sf).withColumn("factors", research.risk_factors())
    return a.select("symbol", F.array_join("factors", ",").alias("factors"), research.risk_level(F.col("factors")).alias("level"))


@query("select symbol, case when change_24h > 8 then 'strongly bullish' when change_24h > 3 then 'positive' when change_24h > 0 then 'mildly bullish' when change_24h > -3 then 'slightly bearish' when change_24h > -8 then 'bearish' else 'capitulation' end as context from v_coin")
def market_context(spark, sf):
    return view(spark, sf, "v_coin").select("symbol", research.market_context(F.col("change_24h")).alias("context"))


def _fixed(x: str, digits: int) -> str:
    """SQL for a number with so many decimals, rounded half up by its size."""
    n = f"cast(floor(abs({x}) * 1e{digits} + 5e-1) as bigint)"
    whole = f"cast({n} // {10**digits} as varchar)"
    part = f", '.', lpad(cast({n} % {10**digits} as varchar), {digits}, '0')" if digits else ""
    return f"concat(case when {x} < 0 and {n} > 0 then '-' else '' end, {whole}{part})"


_SIGNED = f"concat(case when change_24h >= 0 then '+' else '' end, {_fixed('change_24h', 1)}, '%')"
_LEVEL = "case when len(factors) + case when price < 0.1 then 1 else 0 end + case when abs(change_24h) > 15 then 1 else 0 end >= 3 then 'high' else 'medium' end"


@query(f"""
    select f.symbol,
      concat_ws(' ', case when trend = 'bullish' then case when strength > 6e-1 then 'The chart is strong.' else 'The chart is improving.' end end, case when volume_ratio > 1.5 then 'Volume supports the move.' end,
        case when change_24h > 5 then 'The pace may carry on.' when change_24h > 0 then 'Buyers build up slowly.' else 'Oversold assets tend to find buyers.' end, case when category <> '' then concat('The ', category, ' narrative gains ground.') end) as bull_case,
      concat_ws(' ', case when trend = 'bearish' then 'The chart weakens.' end, case when volume_ratio < 1 then 'Volume is thin.' end, case when market_cap > 1e11 then 'Large assets move slowly.' when change_24h < -5 then 'The downtrend holds.' else 'The pace may fade without volume.' end) as bear_case,
      concat_ws(' ', case when catalyst is not null then concat(f.symbol, ' has a ', catalyst, ' announcement.') end, concat(f.symbol, ' moved ', {_SIGNED}, ' at ', {_fixed('volume_ratio', 1)}, 'x volume.'), case when pattern <> '' then concat('Pattern: ', pattern, '.') end) as reason,
      concat(case when {_LEVEL} = 'high' then 'High' else 'Medium' end, ' risk: ', factors[1], '.') as risk_note
    from $factors f join $patterns p on p.symbol = f.symbol""")
def asset_thesis(spark, sf):
    return research.thesis(patterned(spark, sf)).select("symbol", "bull_case", "bear_case", "reason", "risk_note")


@query("select symbol, stage, freshness, volume_level, interest, tradable, repetition, move_detail, volume_confirms from $flags")
def research_flags(spark, sf):
    return research.research_flags(rich(spark, sf)).select("symbol", "stage", "freshness", "volume_level", "interest", "tradable", "repetition", "move_detail", "volume_confirms")


@query("""
    select symbol, array_to_string(case when len(w) > 0 then w[1:3] else ['setup developing'] end, ',') as reasons from (select symbol, list_filter([case when catalyst is not null then concat(catalyst, ' catalyst') end, case when abs(change_24h) > 5 then 'strong move' end,
      case when volume_ratio > 2 then 'volume confirms' end, case when category <> '' then concat(category, ' narrative') end], lambda x: x is not null) as w from $rich)""")
def why_now(spark, sf):
    return rich(spark, sf).select("symbol", F.array_join(research.why_now(), ",").alias("reasons"))


@query(f"""
    select symbol, array_to_string(list_filter([concat('ASSET: ', symbol, ' (', name, ')'), '-- MARKET --', concat('Price: ', {_fixed('price', 6)}), concat('Change: ', {_SIGNED}), concat('Volume: ', {_fixed('volume_24h', 0)}, ', ', {_fixed('volume_ratio', 1)}, 'x'), concat('Market cap: ', {_fixed('market_cap', 0)}),
      '-- CATALYST --', concat('Type: ', upper(coalesce(catalyst, 'market movement'))), concat('Detail: ', move_detail), '-- TIMING --', concat('Stage: ', stage), '-- NARRATIVE --', concat('Sector: ', coalesce(nullif(category, ''), 'NONE')), concat('Freshness: ', freshness),
      '-- VOLUME --', concat('Level: ', volume_level), '-- AUDIENCE --', concat('Interest: ', interest), '-- TRADING --', concat('Ready: ', tradable), '-- RISK --', concat('Level: ', upper({_LEVEL})), concat('Factors: ', array_to_string(factors, '; ')), '-- REPETITION --', concat('Risk: ', repetition),
      '-- WHY NOW --', array_to_string(case when len(w) > 0 then w[1:3] else ['setup developing'] end, chr(10))], lambda x: x is not null), chr(10)) as package
    from (select g.*, f.factors, list_filter([case when g.catalyst is not null then concat(g.catalyst, ' catalyst') end, case when abs(g.change_24h) > 5 then 'strong move' end, case when g.volume_ratio > 2 then 'volume confirms' end, case when g.category <> '' then concat(g.category, ' narrative') end], lambda x: x is not null) as w
      from $flags g join $factors f on f.symbol = g.symbol)""")
def research_package(spark, sf):
    a = research.research_flags(rich(spark, sf)).withColumn("factors", research.risk_factors())
    a = a.withColumns({"risk": research.risk_level(F.col("factors")), "why": research.why_now()})
    return research.research_package(a).select("symbol", "package")


@query("select symbol, case when change_24h > 5 and volume_ratio > 1.5 then 'FOMO Bull' when change_24h < -3 then 'Panic Bear' else 'Cold Analyst' end as persona from $assets")
def tone(spark, sf):
    return assets(spark, sf).select("symbol", research.tone(F.col("change_24h"), F.col("volume_ratio")).alias("persona"))


@query("""
    select symbol, case when catalyst = 'new_listing' then 'listing' when catalyst = 'airdrop' then 'airdrop' when s >= 10 then 'breakout' when s >= 5 then 'momentum' when s >= 3 then 'traction' when volume_ratio >= 3 then 'volume spike' when volume_ratio >= 2 then 'volume surge'
      when category = 'AI' then 'ai' when category = 'MEME' then 'meme' when change_24h <= 0 then 'discount' else 'trend' end as headline from (select *, abs(change_24h) as s from $rich)""")
def headline_class(spark, sf):
    return rich(spark, sf).select("symbol", research.headline_class(F.col("catalyst"), F.col("category")).alias("headline"))


@query("""
    select symbol, array_to_string((f || case when len(f) < 2 then ['market structure', 'indicators aligned'] when len(f) < 3 then ['market structure'] else [] end)[1:5], ',') as reasons from (select symbol, list_filter([
      case when s >= 10 then 'explosive move' when s >= 5 then 'strong move' when s >= 3 then 'trending' else 'notable action' end, case when volume_ratio >= 3 then 'volume spike' when volume_ratio >= 2 then 'high volume' when volume_ratio >= 1.5 then 'healthy volume' else '' end,
      case when category <> '' then concat(category, ' narrative') else '' end, case when catalyst is not null then concat(catalyst, ' announcement') else '' end, case when least(s * 3 + volume_ratio * 10, 1e2) > 70 then 'elite score' when pk % 12 > 5 then 'hot search' else '' end],
      lambda x: x <> '') as f from (select *, abs(change_24h) as s from $rich))""")
def card_reasons(spark, sf):
    score = scoring.heuristic_score(F.col("change_24h"), F.col("volume_ratio"))
    return rich(spark, sf).select("symbol", F.array_join(research.card_reasons(F.col("catalyst"), F.col("category"), score, F.col("pk") % 12), ",").alias("reasons"))


@query("""
    select symbol, case when catalyst in ('new_listing', 'airdrop', 'launchpool') then 'listing' when catalyst = 'delisting' then 'breakout' when contains(lower(category), 'ai') then 'ai_narrative' when contains(lower(category), 'meme') then 'meme'
      when contains(lower(category), 'defi') then 'defi' when contains(lower(category), 'rwa') then 'narrative' when volume_ratio > 3 then 'breakout' else 'default' end as template from $rich""")
def template_pick(spark, sf):
    return rich(spark, sf).select("symbol", research.template(F.col("catalyst"), F.col("category"), F.col("symbol"), F.col("volume_ratio")).alias("template"))


@query("select symbol, case when pk % 9 > 5 then 'HIGH' when pk % 9 > 2 then 'MEDIUM' else 'LOW' end as risk_badge, case when pk % 11 = 0 then 'LOW' when score < 60 then 'MEDIUM' else 'HIGH' end as confidence_badge from $scored")
def card_badges(spark, sf):
    risk, confidence = research.badges(F.col("pk") % 9, F.col("score"), F.col("pk") % 11 == 0)
    return scored(spark, sf).select("symbol", risk.alias("risk_badge"), confidence.alias("confidence_badge"))


# Readers of landed payloads: the views are written as payloads, a page to a line, and read again.


def _pages(rows: DataFrame, page: Column, order: str, item: Column, wrap: Callable[[Column], Column], *keys: str) -> DataFrame:
    """Lines of JSON, one for each page of rows in their order; a page has a bounded number of rows."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(*keys, page.alias("page")).agg(ordered.alias("items")).select(F.to_json(wrap(F.col("items"))).alias("value"))


@query("select symbol, name, price, change_24h, volume_24h, market_cap, cast(least(pk % 13, 10) as integer) as n_points, case when pk % 13 > 0 then price + pk % 13 end as last_point from v_coin")
def market_feed(spark, sf):
    points = F.transform(F.sequence(F.lit(0), (F.col("pk") % 13).cast("int")), lambda i: F.col("price") + i)
    item = F.struct(
        F.concat(F.lower("symbol"), F.lit(" ")).alias("symbol"), "name", F.col("price").alias("current_price"), F.col("change_24h").alias("price_change_percentage_24h"), F.col("volume_24h").alias("total_volume"), "market_cap",
        F.struct(F.slice(points, 2, 13).alias("price")).alias("sparkline_in_7d"),
    )
    path = landing.land(_pages(view(spark, sf, "v_coin"), F.floor(F.col("pk") / 50), "pk", item, lambda x: x), "market")
    got = feeds.read_market(spark, path, lines=True)
    return got.select("symbol", "name", "price", "change_24h", "volume_24h", "market_cap", F.size("history").alias("n_points"), F.try_element_at("history", F.lit(-1)).alias("last_point"))


@query("select symbol from v_coin where pk % 9 <> 0 and pk % 5 <> 0")
def exchange_feed(spark, sf):
    pairs = view(spark, sf, "v_coin").withColumn("quote", F.explode(F.array(F.lit("USDT"), F.lit("BTC"))))
    item = F.struct(F.lower("symbol").alias("baseAsset"), F.when(F.col("pk") % 9 == 0, "BREAK").otherwise("TRADING").alias("status"), (F.col("pk") % 5 != 0).alias("isSpotTradingAllowed"))
    path = landing.land(_pages(pairs, F.floor(F.col("pk") / 50), "pk", item, lambda x: F.struct(x.alias("symbols"))), "exchange")
    return feeds.read_listed(spark, path, lines=True)


_ANN_HOUR = "date_trunc('hour', released_at)"


@query(f"""
    select ann_type, case when ann_type = 'news' then 'medium' else 'high' end as impact, title, epoch_us(released_at) // 1000 as released_ms
    from (select *, row_number() over (partition by ann_type, {_ANN_HOUR} order by ann_id) as i from v_ann) where i <= 5 and hour(released_at) <> 13""")
def announcement_feed(spark, sf):
    ids = F.create_map(*[F.lit(x) for k, v in feeds.CATALOG_KINDS.items() for x in (v[0], k)])
    ann = view(spark, sf, "v_ann").withColumn("at", F.col("released_at").cast("timestamp")).withColumns({"catalogId": ids[F.col("ann_type")].cast("long"), "hour": F.date_trunc("hour", "at")})
    item = F.struct("title", F.unix_millis("at").alias("releaseDate"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ann_id", item.alias("item")))), lambda x: x["item"])
    pages = ann.groupBy("catalogId", "hour").agg(ordered.alias("articles"))
    code = F.when(F.hour("hour") == 13, "000001").otherwise(feeds.OK_CODE)
    lines = pages.select(F.to_json(F.struct(code.alias("code"), F.struct(F.array(F.struct("catalogId", "articles")).alias("catalogs")).alias("data"))).alias("value"))
    got = feeds.read_announcements(spark, landing.land(lines, "announcements"), lines=True)
    return got.select("ann_type", "impact", "title", F.unix_millis("released_at").alias("released_ms"))


@query("""
    select source, chain_id, symbol, price, cast(ord as integer) as ord, risk_level from (
      select r.source, r.chain_id, c.symbol, c.pk, c.price, case when c.pk % 4 = 0 then 1 else c.risk_level end as risk_level, row_number() over (partition by rank_type, chain_id, c.pk // 200 order by c.pk) - 1 as ord
      from v_rank r join v_coin c on c.pk = r.pk) where pk % 17 <> 0""")
def rank_list_feed(spark, sf):
    rows = view(spark, sf, "v_rank").drop("symbol").join(view(spark, sf, "v_coin"), "pk")
    item = F.struct(
        F.when(F.col("pk") % 17 == 0, " ").otherwise(F.lower("symbol")).alias("symbol"), F.col("price").cast("string").alias("price"), F.col("volume_24h").cast("string").alias("volume24h"),
        F.when(F.col("pk") % 4 != 0, F.struct(F.col("risk_level").alias("riskLevel"))).alias("auditInfo"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pk", item.alias("item")))), lambda x: x["item"])
    pages = rows.groupBy("rank_type", "chain_id", F.floor(F.col("pk") / 200).alias("page")).agg(ordered.alias("tokens"))
    lines = pages.select(F.to_json(F.struct(F.lit(feeds.OK_CODE).alias("code"), "rank_type", "chain_id", F.struct("tokens").alias("data"))).alias("value"))
    got = feeds.read_rank_lists(spark, landing.land(lines, "ranks"), lines=True)
    return got.select("source", "chain_id", "symbol", "price", "ord", "risk_level")


@query("select cast(ord as integer) as ord, symbol, name, cast(pk % 15 as integer) as search_score from (select *, row_number() over (partition by pk // 40 order by pk) - 1 as ord from v_coin) where ord < 15")
def trending_feed(spark, sf):
    item = F.struct(F.struct(F.lower("symbol").alias("symbol"), "name", (F.col("pk") % 15).alias("score")).alias("item"))
    path = landing.land(_pages(view(spark, sf, "v_coin"), F.floor(F.col("pk") / 40), "pk", item, lambda x: F.struct(x.alias("coins"))), "trending")
    return feeds.read_trending(spark, path, lines=True)


@query("select concat(symbol, 'USDT') as symbol, case when pk % 8 = 0 then 0e0 else price end as price, change_24h, volume_24h, case when pk % 6 = 0 then 0 else pk end as trades from v_coin")
def ticker_feed(spark, sf):
    item = F.struct(
        F.concat("symbol", F.lit("USDT")).alias("symbol"), F.when(F.col("pk") % 8 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("lastPrice"), F.col("change_24h").cast("string").alias("priceChangePercent"),
        F.col("volume_24h").cast("string").alias("quoteVolume"), F.when(F.col("pk") % 6 != 0, F.col("pk")).alias("count"),
    )
    return feeds.read_tickers(spark, landing.land(_pages(view(spark, sf, "v_coin"), F.floor(F.col("pk") / 50), "pk", item, lambda x: x), "tickers"), lines=True)


@query("select cast(ord as integer) as ord, close_px from (select close_px, l_linenumber, row_number() over (partition by symbol, year(ts) order by ts, l_orderkey, l_linenumber) - 1 as ord from v_tick) where l_linenumber <> 7")
def candle_feed(spark, sf):
    close = F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.col("close_px").cast("string"))
    candle = F.array(F.col("ts").cast("string"), F.lit("1"), F.lit("2"), F.lit("0"), close)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "l_orderkey", "l_linenumber", candle.alias("candle")))), lambda x: x["candle"])
    lines = view(spark, sf, "v_tick").groupBy("symbol", F.year("ts").alias("year")).agg(ordered.alias("c")).select(F.to_json("c").alias("value"))
    return feeds.read_candles(spark, landing.land(lines, "candles"), lines=True).select("ord", "close_px")


@query("select id, symbol, strftime(created_at, '%Y-%m-%d') as day from v_post")
def table_insert(spark, sf):
    """Posts appended to a table partitioned by day, in two writes."""
    posts, path = view(spark, sf, "v_post").select("id", "symbol", "created_at"), f"{landing.landing_dir(spark)}/posts"
    for part in (posts.where("id % 2 = 0"), posts.where("id % 2 <> 0")):
        feeds.write_table(part, path)
    return spark.read.parquet(path).select("id", "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("select strftime(created_at, '%Y-%m-%d') as day, case when id % 10 = 0 then 'rejected' else 'published' end as status, count(*) as n, min(id) as first_id from v_post group by all")
def artifact_table(spark, sf):
    rows = view(spark, sf, "v_post").select("id", "content", F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.when(F.col("id") % 10 == 0, "rejected").otherwise("published").alias("status"))
    path = f"{landing.landing_dir(spark)}/artifacts"
    feeds.write_artifacts(rows, path)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""
    select strftime(created_at, '%Y-%m-%d') as day, case when id % 10 = 0 then 'rejected' else 'published' end as status, count(*) as n, cast(sum(id) as bigint) as ids, count(distinct id) as n_ids, true as few_files
    from v_post group by all""")
def artifact_compacted(spark, sf):
    """Artifacts of five appends, whose small files are brought together; a day and status has few files then."""
    rows = view(spark, sf, "v_post").select("id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.when(F.col("id") % 10 == 0, "rejected").otherwise("published").alias("status"))
    path = f"{landing.landing_dir(spark)}/artifacts"
    kept = landing.written(rows, "rows")
    for i in range(5):
        feeds.write_artifacts(kept.where(F.col("id") % 5 == i), path)
    feeds.compact_artifacts(spark, path)
    named = F.date_format("day", "yyyy-MM-dd").alias("day")
    found = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = F.count_distinct(F.when(F.col("size") < 32 << 20, F.col("file")))
    return found.groupBy(named, "status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count_distinct("id").alias("n_ids"), (files < 4).alias("few_files"))


@query("""select content, symbol as coin_symbol, concat('{"catalyst":"', catalyst_type, '"}') as metadata from v_post""")
def post_records(spark, sf):
    named = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("content"), F.col("content"), F.lit("coin_symbol"), F.col("symbol"), F.lit("catalyst"), F.col("catalyst_type")))
    older = F.create_map(F.lit("text"), F.col("content"), F.lit("symbol"), F.col("symbol"), F.lit("catalyst"), F.col("catalyst_type"))
    return feeds.post_record(view(spark, sf, "v_post").select(F.coalesce(named, older).alias("fields")))


# Tables with ids. Each is written in two appends; ``first_append`` tells which one an id is from.


def _two_appends(rows: DataFrame, table: str, order: tuple[str, ...] = ()) -> tuple[DataFrame, tuple[int, int]]:
    path = f"{landing.landing_dir(rows.sparkSession)}/{table}"
    first = tables.append(rows.where("id % 2 = 0").drop("id"), path, table, order)
    tables.append(rows.where("id % 2 <> 0").drop("id"), path, table, order)
    return tables.read(rows.sparkSession, path, table).withColumn("first_append", F.col("id") <= first[1]), first


def _stamped(spark, sf) -> DataFrame:
    """Posts of the view with a time that Spark's tables keep."""
    return view(spark, sf, "v_post").withColumn("created_at", F.col("created_at").cast("timestamp"))


def _plain_time(name: str = "created_at") -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("""
    select case when id % 2 = 0 then 0 else (select count(*) from v_post where id % 2 = 0) end + row_number() over (partition by id % 2 order by created_at, content, symbol) as id,
      created_at, symbol as coin_symbol, content, id % 2 = 0 as first_append, strftime(created_at, '%Y-%m-%d') as day from v_post""")
def table_posts(spark, sf):
    """Ids in the order of time within each append."""
    rows = _stamped(spark, sf).select("id", "created_at", F.col("symbol").alias("coin_symbol"), "content")
    out, _ = _two_appends(rows, "posts", ("created_at", "content", "coin_symbol"))
    return out.select("id", _plain_time(), "coin_symbol", "content", "first_append", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("select id as post_id, created_at, coalesce(views, 0) as views, coalesce(traders, 0) as traders, id % 2 = 0 as first_append from v_post")
def table_metrics(spark, sf):
    rows = _stamped(spark, sf).select("id", F.col("id").alias("post_id"), "created_at", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("traders", F.lit(0)).alias("traders"))
    return _two_appends(rows, "metrics")[0].select("post_id", _plain_time(), "views", "traders", "first_append")


@query("select created_at, catalyst_type as status, concat('{\"posts\":', cast(id as varchar), '}') as summary, id % 2 = 0 as first_append from v_post")
def table_runs(spark, sf):
    rows = _stamped(spark, sf).select("id", "created_at", F.col("catalyst_type").alias("status"), F.to_json(F.struct(F.col("id").alias("posts"))).alias("summary"))
    return _two_appends(rows, "runs")[0].select(_plain_time(), "status", "summary", "first_append")


def _analytics(spark, sf) -> DataFrame:
    i = F.col("id")
    rows = reports.post_features(_stamped(spark, sf)).withColumns({
        "post_id": i, "coin_symbol": F.col("symbol"), "trade_setup_style": F.col("setup_style"), "eligible_traders": F.col("traders"), "likes": i % 50,
        "comments": F.when(i % 5 != 0, i % 9), "reward_earned": F.when(i % 6 != 0, (i % 1000).cast("double") / 8),
    })
    return rows


@query("""
    select id as post_id, symbol as coin_symbol, created_at, catalyst_type, narrative, hook_style, setup_style as trade_setup_style, word_count, hashtags, views, traders as eligible_traders, 0 as is_analyzed, id % 2 = 0 as first_append
    from $featured""")
def table_analytics(spark, sf):
    out = _two_appends(_analytics(spark, sf), "post_analytics")[0]
    return out.select(
        "post_id", "coin_symbol", _plain_time(), "catalyst_type", "narrative", "hook_style", "trade_setup_style", "word_count", "hashtags", "views", "eligible_traders", "is_analyzed", "first_append"
    )


@query("""
    with n as (select count_if(id % 2 = 0) as a, count(*) as b from v_post), t as (select unnest(['metrics', 'post_analytics', 'posts', 'runs']) as table_name)
    select table_name, true as first_append, a as n, a as n_ids, 1 as first_id, a as last_id from t, n union all select table_name, false, b - a, b - a, a + 1, b from t, n""")
def table_ids(spark, sf):
    """Ids of all four tables: dense, each once, and going on from the largest one."""
    posts = _stamped(spark, sf)
    rows = {
        "posts": posts.select("id", "created_at", "content"), "metrics": posts.select("id", "created_at", F.lit(1).alias("views"), F.lit(2).alias("traders")),
        "runs": posts.select("id", "created_at", F.lit("done").alias("status")), "post_analytics": posts.select("id", "created_at", F.col("symbol").alias("coin_symbol")),
    }
    out = None
    for table, frame in rows.items():
        found = _two_appends(frame, table)[0].groupBy("first_append").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        found = found.withColumn("table_name", F.lit(table))
        out = found if out is None else out.unionByName(found)
    return out


@query("""
    with b as (select *, id % 50 as likes, case when id % 5 <> 0 then id % 9 end as comments, case when id % 6 <> 0 then cast(id % 1000 as double) / 8 end as reward from v_post),
    t as (select symbol, arg_max(id, (created_at, id)) as id from v_post where views is null group by symbol),
    u as (select t.id, c.pk * 10 as v, case when c.pk % 2 = 0 then c.pk end as tr, case when c.pk % 3 = 0 then c.pk + 1 end as co, c.pk % 4 as sh, case when c.pk % 5 = 0 then c.change_24h end as re from t join v_coin c on c.symbol = t.symbol)
    select b.id as post_id, b.symbol as coin_symbol, coalesce(u.v, b.views) as views, coalesce(u.tr, b.traders) as eligible_traders, b.likes, coalesce(u.co, b.comments) as comments, u.sh as shares, coalesce(u.re, b.reward) as reward_earned,
      case when u.id is not null then timestamp '2024-02-01 00:00:00' end as metrics_updated_at, strftime(b.created_at, '%Y-%m-%d') as day
    from b left join u on u.id = b.id""")
def metrics_written(spark, sf):
    """Updates written into the table, and the table read again."""
    path, pk = f"{landing.landing_dir(spark)}/post_analytics", F.col("pk")
    tables.append(_analytics(spark, sf).drop("id"), path, "post_analytics", ("created_at", "post_id"))
    updates = view(spark, sf, "v_coin").select(
        F.lower("symbol").alias("coin_symbol"), (pk * 10).alias("views"), F.when(pk % 2 == 0, pk).alias("eligible_traders"), F.when(pk % 3 == 0, pk + 1).alias("comments"), (pk % 4).alias("shares"),
        F.when(pk % 5 == 0, F.col("change_24h")).alias("reward_earned"),
    )
    tables.update_measures(spark, path, updates, F.lit("2024-02-01").cast("timestamp"))
    return tables.read(spark, path, "post_analytics").select(
        "post_id", "coin_symbol", "views", "eligible_traders", "likes", "comments", "shares", "reward_earned", _plain_time("metrics_updated_at"), F.date_format("day", "yyyy-MM-dd").alias("day")
    )


@query("select id as post_id, symbol as coin_symbol, created_at from v_post order by created_at desc, id desc limit 100")
def newest_posts(spark, sf):
    """The end of a table, read from its newest days."""
    path = f"{landing.landing_dir(spark)}/post_analytics"
    tables.append(_stamped(spark, sf).select("created_at", F.col("id").alias("post_id"), F.col("symbol").alias("coin_symbol")), path, "post_analytics", ("created_at", "post_id"))
    return tables.newest(spark, path, "post_analytics", 100).select("post_id", "coin_symbol", _plain_time())


# Streams over landed rows: each run takes what has landed and stops; the next one goes on from its checkpoint.


def _beat(posts: DataFrame, schema: str, hours: int) -> DataFrame:
    """A row without an id that moves the watermark on, so long after the last post."""
    row = posts.agg((F.max("created_at") + F.make_dt_interval(hours=F.lit(hours))).alias("created_at"))
    return row.select(*[F.col(c) if c == "created_at" else F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in schema.split(", "))])


_POSTS = "id long, symbol string, created_at timestamp, signature string"
_DELAY_HOURS = 24 * 366


def _post_stream(spark, sf, rule) -> DataFrame:
    """Posts land in files that overlap in time and go through a rule in several batches; a second run ends it."""
    base = landing.landing_dir(spark)
    posts = _stamped(spark, sf).select("id", "symbol", "created_at", F.lit(None).cast("string").alias("signature"))
    for rows in (posts.repartition(6), _beat(posts, _POSTS, 3 * _DELAY_HOURS).coalesce(1)):
        rows.write.mode("append").parquet(f"{base}/landed")
        streams.run_to_table(rule(streams.landed(spark, f"{base}/landed", _POSTS, files_per_batch=3), f"{_DELAY_HOURS} hours"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("id long, symbol string, created_at timestamp").parquet(f"{base}/out").select("id", "symbol")


@query("""
    with recursive p as (select id, symbol, created_at from v_post), a as (
      select id, symbol, created_at from (select *, row_number() over (partition by symbol order by created_at, id) as i from p) where i = 1
      union all select id, symbol, created_at from (
        select p.*, row_number() over (partition by p.symbol order by p.created_at, p.id) as i from a join p on p.symbol = a.symbol and p.created_at >= a.created_at + interval 24 hour) where i = 1)
    select id, symbol from a""")
def stream_cooldown(spark, sf):
    return _post_stream(spark, sf, lambda rows, delay: streams.cooldown(rows, delay=delay))


@query("select id, symbol from (select *, row_number() over (partition by cast(created_at as date) order by created_at, id) as i from v_post) where i <= 8")
def stream_daily_cap(spark, sf):
    return _post_stream(spark, sf, lambda rows, delay: streams.daily_cap(rows, delay=delay))


@query("""
    with s as (select distinct left(sha256(concat_ws('|', symbol, content)), 16) as signature from v_post)
    select signature, i as run from s, (select unnest([0, 2]) as i)""")
def stream_signatures(spark, sf):
    """All posts land three times: the second time within the watermark of the first, so that nothing comes out, the third
    time when the first ones have been forgotten."""
    base, shift = landing.landing_dir(spark), lambda hours: (F.col("created_at") + F.make_dt_interval(hours=F.lit(hours))).alias("created_at")
    posts = _stamped(spark, sf).select("id", "symbol", "created_at", text.signature("symbol", "content").alias("signature"))
    delay = 24 * 40
    for run, rows in enumerate((posts, posts.select("id", "symbol", shift(1), "signature"), _beat(posts, _POSTS, 3 * delay), posts.select("id", "symbol", shift(4 * delay), "signature"))):
        rows.repartition(2 if run != 2 else 1).write.mode("append").parquet(f"{base}/landed")
        streams.run_to_table(streams.first_signatures(streams.landed(spark, f"{base}/landed", _POSTS), f"{delay} hours"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema(_POSTS).parquet(f"{base}/out").where("signature is not null")
    return out.select("signature", F.when(F.col("created_at") > F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=F.lit(delay)), 2).otherwise(F.when(F.col("created_at").isNull(), 1).otherwise(0)).alias("run"))


@query("select symbol, arg_max(id, (created_at, id)) as id from v_post group by symbol")
def stream_latest(spark, sf):
    """The newest row of each symbol, kept over batches and merged on the way."""
    base = landing.landing_dir(spark)
    _stamped(spark, sf).select("symbol", F.struct("created_at", "id").alias("ts"), "id").repartition(5).write.parquet(f"{base}/landed")
    rows = streams.landed(spark, f"{base}/landed", "symbol string, ts struct<created_at:timestamp,id:long>, id long", files_per_batch=1)
    streams.keep_latest(rows, f"{base}/latest", f"{base}/checkpoint", merge_every=2).awaitTermination()
    return streams.read_latest(spark, f"{base}/latest").select("symbol", "id")


@query(f"select case when {_BROKEN} then 'quarantine' else 'clean' end as kind, count(*) as n, min(case when not {_BROKEN} then created_at end) as first_at from v_post group by 1")
def stream_history(spark, sf):
    """Lines of a history as a stream to two sinks."""
    base = landing.landing_dir(spark)
    lines = streams.landed(spark, _history_path(spark, sf), feeds.HISTORY, "json", files_per_batch=3)
    streams.split_history(lines, f"{base}/sinks", f"{base}/checkpoint").awaitTermination()
    clean = history.clean_history(streams.read_history_sink(spark, f"{base}/sinks", "clean"))
    kept = clean.agg(F.lit("clean").alias("kind"), F.count("*").alias("n"), F.min("created_at").cast("timestamp_ntz").alias("first_at"))
    bad = streams.read_history_sink(spark, f"{base}/sinks", "quarantine")
    return kept.unionByName(bad.agg(F.lit("quarantine").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("timestamp_ntz").alias("first_at")))


@query(f"select count_if(not {_BROKEN}) as n_valid, count_if({_BROKEN}) as n_corrupt from v_post")
def stream_audit(spark, sf):
    """The counts that come with a history stream's batches, from the log that a listener keeps."""
    base = landing.landing_dir(spark)
    lines = streams.landed(spark, _history_path(spark, sf), feeds.HISTORY, "json", files_per_batch=3)
    log = audits.AuditLog(spark, f"{base}/audit")
    spark.streams.addListener(log)
    try:
        run = streams.split_history(audits.observed(lines), f"{base}/sinks", f"{base}/checkpoint")
        run.awaitTermination()
        log.wait(run)
    finally:
        spark.streams.removeListener(log)
    return audits.totals(spark, f"{base}/audit", f"{base}/sinks", str(run.id))


_SCANS, _SCAN_STEP = 11, 2


def _scan_assets(spark, sf) -> DataFrame:
    """The scored assets with what the cascade asks for, in 20 feeds."""
    s = scored(spark, sf).select("pk", "symbol", "price", "market_cap", "change_24h", "liquidity", "risk_level", "volume_ratio", "score")
    joined = s.join(firsts(spark, sf), "symbol", "left").join(view(spark, sf, "v_listed").select("symbol", F.lit(True).alias("listed")), "symbol", "left")
    return joined.select((F.col("pk") % 20).cast("string").alias("feed"), "*").withColumn("listed", F.coalesce("listed", F.lit(False)))


_SCANS_SQL = f"""
    with recursive base as (select cast(s.pk % 20 as varchar) as feed, s.*, f.catalyst, l.symbol is not null as listed, coalesce(f.catalyst in ('new_listing', 'launchpool', 'megadrop', 'airdrop', 'delisting'), false) as ex
      from $scored s left join $firsts f on f.symbol = s.symbol left join v_listed l on l.symbol = s.symbol),
    snaps as (select feed, pk, symbol, price, market_cap, liquidity, risk_level, volume_ratio, catalyst, listed, ex, k, timestamp '{AS_OF}' + interval 4 hour + interval {_SCAN_STEP} hour * k as tm,
        change_24h + k as change_24h, least(score + (pk * 31 + k * 17) % 30, 1e2) as score from base, (select unnest(range({_SCANS})) as k)),
    fine as (select *, case when score >= 75 then 'direct' when score >= 60 then 'review' else 'reject' end as decision,
        symbol <> '' and price > 0 and price >= 1e-4 and not (market_cap > 0 and market_cap < 1e5) and abs(change_24h) <= 150 and not (liquidity > 0 and liquidity < 1e4) and risk_level < 3
          and (catalyst is not null or abs(change_24h) > 2.5 or volume_ratio > 1.5) and listed and not (pk <= 5 and (not ex or abs(change_24h) < 5)) as ok from snaps),
    seeds as (select cast(cast(substr(symbol, 2) as bigint) % 20 as varchar) as feed, symbol, max(created_at) as last_at from v_post group by all),
    seen as (select fine.*, s.last_at from fine left join seeds s on s.feed = fine.feed and s.symbol = fine.symbol),
    st as (
      select cast(-1 as bigint) as k, feed, cast([] as struct(symbol varchar, tm timestamp, score double)[]) as posted from (select distinct feed from base)
      union all
      select k, feed, case when pick is null or len(list_filter(posted, lambda p: cast(p.tm as date) = cast(now_at as date))) >= 8 then posted else list_append(posted, pick) end from (
        select k, feed, posted, now_at, arg_min({{'symbol': symbol, 'tm': now_at, 'score': score}}, (case when decision = 'direct' then 0 else 1 end, place)) filter (
            passed and ((decision = 'direct' and place = 1) or (decision = 'review' and place <= 5 and (hours_ago is null or hours_ago >= 24)))) as pick
        from (select *, row_number() over (partition by feed, decision, passed order by score desc, symbol) as place from (
          select *, ok and decision <> 'reject' and (ex or hours_ago is null or not (hours_ago < 24 or (hours_ago < 48 and abs(change_24h) < 5))) as passed from (
            select seen.k, seen.feed, seen.symbol, seen.tm as now_at, seen.score, seen.decision, seen.ok, seen.ex, seen.change_24h, st.posted,
              (epoch_us(seen.tm) - epoch_us(greatest(seen.last_at, list_max(list_transform(list_filter(st.posted, lambda p: p.symbol = seen.symbol), lambda p: p.tm))))) / 3.6e9 as hours_ago
            from st join seen on seen.k = st.k + 1 and seen.feed = st.feed)))
        group by k, feed, posted, now_at))"""


def _scanned(spark, sf, runs: bool = False) -> str:
    """Scans every two hours go on from the posts at hand, in two runs; the folder of what they wrote."""
    base, k = landing.landing_dir(spark), F.col("k")
    scans.begin(_stamped(spark, sf).select((F.expr("cast(substring(symbol, 2) as bigint)") % 20).cast("string").alias("feed"), "symbol", "created_at", F.lit(0.0).alias("score"), F.col("catalyst_type").alias("catalyst")), f"{base}/posted")
    at = lambda n: F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=(4 + n * _SCAN_STEP).cast("int"))
    score = F.least(F.col("score") + (F.col("pk") * 31 + k * 17) % 30, F.lit(100.0))
    changed = {"change_24h": F.col("change_24h") + k, "score": score, "scan": F.unix_micros(at(k))}
    each = landing.written(_scan_assets(spark, sf), "assets").select("*", F.explode(F.sequence(F.lit(0), F.lit(_SCANS - 1))).alias("k")).withColumns(changed).withColumn("decision", scoring.decision(F.col("score")))
    each.drop("pk", "k").hint("rebalance", "scan").write.partitionBy("scan").parquet(f"{base}/assets_by_scan")
    fields = each.drop("pk", "k").schema

    def assets_of(session, scan):
        return session.read.schema(fields).parquet(f"{base}/assets_by_scan").where(F.col("scan") == scan).drop("scan")

    for first, last in ((0, 5), (5, _SCANS)):
        spark.range(first, last, 1, 1).select(at(F.col("id")).alias("at")).write.mode("append").parquet(f"{base}/notices")
        scans.run_scans(streams.landed(spark, f"{base}/notices", scans.NOTICE), assets_of, f"{base}/posted", f"{base}/checkpoint", top=("P1", "P2", "P3", "P4", "P5"), runs=f"{base}/runs" if runs else None).awaitTermination()
    return base


@query(f"""{_SCANS_SQL}
    select feed, p.symbol as symbol, p.tm as created_at, p.score as score from (select feed, unnest(posted) as p from st where k = {_SCANS - 1})""")
def stream_scan(spark, sf):
    """Each scan sees what those before it have posted."""
    return scans.read_posted(spark, f"{_scanned(spark, sf)}/posted").where("batch >= 0").select("feed", "symbol", _plain_time(), "score")


@query(f"""{_SCANS_SQL},
    judged as (
      select k, feed, full_day, ok and (ex or hours_ago is null or not (hours_ago < 24 or (hours_ago < 48 and abs(change_24h) < 5))) as passed from (
        select seen.k, seen.feed, seen.ok, seen.ex, seen.change_24h, len(list_filter(st.posted, lambda p: cast(p.tm as date) = cast(seen.tm as date))) + coalesce(early.n, 0) >= 8 as full_day,
          (epoch_us(seen.tm) - epoch_us(greatest(seen.last_at, list_max(list_transform(list_filter(st.posted, lambda p: p.symbol = seen.symbol), lambda p: p.tm))))) / 3.6e9 as hours_ago
        from st join seen on seen.k = st.k + 1 and seen.feed = st.feed
          left join (select cast(cast(substr(symbol, 2) as bigint) % 20 as varchar) as feed, cast(created_at as date) as day, count(*) as n from v_post group by all) early on early.feed = seen.feed and early.day = cast(seen.tm as date)))
    select timestamp '{AS_OF}' + interval 4 hour + interval {_SCAN_STEP} hour * k as at, feed, count(*) as n_assets, count_if(full_day) as n_capped, count_if(passed and not full_day) as n_passed from judged group by all""")
def stream_scan_runs(spark, sf):
    """The record of each scan: its assets by feed, how many a used-up cap held, how many no rule rejected."""
    runs = scans.read_runs(spark, f"{_scanned(spark, sf, runs=True)}/runs")
    n = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return runs.groupBy(F.timestamp_micros("scan").cast("timestamp_ntz").alias("at"), "feed").agg(
        F.sum("n").alias("n_assets"), n(F.col("outcome") == scans.CAPPED).alias("n_capped"), n(F.col("outcome") == "passed").alias("n_passed"),
    )
