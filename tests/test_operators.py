from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalmill.functions import text
from signalmill.operators import filters, history, lookup, ordering, reports, research, routing, scoring, topics
from signalmill.sources import feeds


def value(spark, column, **fields):
    df = spark.range(1)
    for k, v in fields.items():
        df = df.withColumn(k, v if isinstance(v, type(F.lit(1))) else F.lit(v))
    return df.select(column).first()[0]


BASE = {"symbol": "AAA", "price": 1.0, "market_cap": 1e9, "change_24h": 6.0, "liquidity": 1e6, "risk_level": 1, "volume_ratio": 1.0, "catalyst": "news", "hours_ago": 100.0, "listed": True}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None), ({"symbol": ""}, "empty symbol"), ({"price": 0.0}, "price too low"), ({"price": 5e-5}, "price too low"), ({"market_cap": 5e4}, "market cap too low"), ({"market_cap": 0.0}, None), ({"change_24h": -151.0}, "extreme move"),
        ({"liquidity": 9999.0}, "liquidity too low"), ({"liquidity": 0.0}, None), ({"risk_level": 3}, "high risk"), ({"catalyst": None, "change_24h": 2.5, "volume_ratio": 1.5}, "no catalyst"), ({"catalyst": None, "change_24h": 2.6}, None),
        ({"hours_ago": 11.9}, "hard cooldown"), ({"hours_ago": 12.0}, "soft cooldown"), ({"hours_ago": 24.0}, None), ({"hours_ago": 24.0, "change_24h": 4.9}, "weak move in cooldown"), ({"hours_ago": 48.0, "change_24h": 4.9}, None), ({"hours_ago": 1.0, "catalyst": "airdrop"}, None),
        ({"hours_ago": None}, None), ({"listed": False}, "not listed"), ({"symbol": "BTC"}, "top symbol without reason"), ({"symbol": "BTC", "catalyst": "airdrop"}, None), ({"symbol": "BTC", "catalyst": "airdrop", "change_24h": 4.0}, "top symbol without reason"),
        ({"price": -1.0, "risk_level": 3}, "price too low"),
    ],
)
def test_reject_reason(spark, change, reason):
    kinds = {"symbol": "string", "catalyst": "string", "hours_ago": "double"}
    fields = {k: F.lit(v).cast(kinds[k]) if k in kinds else v for k, v in (BASE | change).items()}
    assert value(spark, filters.reject_reason(), **fields) == reason


def test_stricter_thresholds_outside_the_hub(spark):
    assert value(spark, filters.reject_reason(from_hub=False), **(BASE | {"price": 5e-3})) == "price too low"


def assets(spark, *rows):
    names = "symbol string, price double, change_24h double, volume_24h double, market_cap double, liquidity double, risk_level int, smart_money_pct double, tagged boolean, sources array<string>, n_sources int"
    return spark.createDataFrame(rows, names)


def test_weights_go_to_what_is_known(spark):
    df = assets(spark, ("A", 1.0, 25.0, 0.0, 0.0, 0.0, 1, None, False, ["trending", "top_search"], 2), ("B", 1.0, 0.0, 0.0, 0.0, 0.0, 1, None, False, [], 0))
    rows = {r.symbol: r for r in scoring.weighted_score(scoring.components(df)).collect()}
    want = (100 * 0.2 + 100 * 0.15 + 100 * 0.05 + 50 * 0.05) / (0.2 + 0.15 + 0.05 + 0.05) + 10
    assert rows["A"].score == pytest.approx(min(100, want), abs=0.05)
    assert not rows["A"].a_volume and not rows["A"].a_market_cap
    assert rows["B"].score == pytest.approx(20 * 0.05 / 0.45, abs=0.05)
    assert sum(scoring.WEIGHTS.values()) == pytest.approx(1)


def test_penalties_and_range(spark):
    everything = ["trending", "top_search", "smart_money", "alpha"]
    df = assets(spark, *[(f"R{i}", p, 30.0, 1e9, 1e9, 1e7, r, 50.0, True, everything, 4) for i, (p, r) in enumerate([(1.0, 1), (1.0, 2), (1.0, 3), (5e-4, 1), (5e-5, 1)])])
    got = [r.score for r in scoring.weighted_score(scoring.components(df)).orderBy("symbol").collect()]
    assert got[0] == 100.0
    assert got[0] >= got[1] > got[2] and got[3] > got[4] > 0
    assert all(0 <= s <= 100 for s in got)


@pytest.mark.parametrize("score, gate", [(75.0, "direct"), (74.9, "review"), (60.0, "review"), (59.9, "reject")])
def test_gate(spark, score, gate):
    assert value(spark, scoring.decision(F.col("s")), s=score) == gate


@pytest.mark.parametrize(
    "points, change, want",
    [
        ([], 0.0, ("neutral", 0.5, "", "medium")), ([1.0, 1.0, 1.0, 1.0], 9.0, ("neutral", 0.5, "", "medium")), ([1.0, 1.0, 1.0, 1.0, 1.2], 6.0, ("bullish", 1.0, "breakout", "high")), ([1.0, 1.0, 1.0, 1.0, 1.06], 1.0, ("bullish", 0.3, "steady uptrend", "medium")),
        ([1.0, 1.0, 1.0, 1.0, 0.9], -6.0, ("bearish", 0.3, "sharp selloff", "high")), ([1.0, 1.0, 1.0, 1.0, 1.01], 1.0, ("neutral", 0.5, "ranging", "low")), ([1.0, 1.0, 1.0, 1.0, 1.01], -3.0, ("neutral", 0.5, "downward bias", "low")), ([0.0, 0.0, 0.0, 0.0, 0.0], 0.0, ("neutral", 0.5, "ranging", "medium")),
    ],
)
def test_price_pattern(spark, points, change, want):
    df = spark.createDataFrame([(points, change)], "points array<double>, change_24h double")
    r = research.price_pattern(df).first()
    assert (r.trend, pytest.approx(r.strength), r.pattern, r.volatility) == want


def test_history_lines(spark, tmp_path):
    lines = [
        '{"symbol": " inj ", "timestamp": "2026-06-27T10:55:03.555169+00:00", "catalyst": "market_move", "link": "x"}', '{"symbol": "WIF", "timestamp": "2026-06-27T11:30:00+05:30", "catalyst": "news", "link": "x", "image_url": "i", "media_id": "m"}',
        "not json", "[1, 2]", '{"symbol": null, "timestamp": "2026-06-27T11:30:00+00:00"}', '{"symbol": "A", "timestamp": ""}', '{"symbol": "", "timestamp": "2026-06-27T11:30:00+00:00"}',
    ]
    (tmp_path / "h.jsonl").write_text("\n".join(lines))
    raw = feeds.read_history(spark, str(tmp_path / "h.jsonl"))
    assert raw.count() == 7
    rows = {r.symbol: r for r in history.clean_history(raw).collect()}
    assert set(rows) == {"INJ", "WIF"}
    assert rows["WIF"].created_at == datetime(2026, 6, 27, 6, 0)
    feeds.append_history(raw.where("symbol = 'WIF'"), str(tmp_path / "log"))
    feeds.append_history(raw.where("symbol = 'WIF'"), str(tmp_path / "log"))
    assert feeds.read_history(spark, str(tmp_path / "log")).count() == 2


def posts(spark, *rows):
    return spark.createDataFrame([(i, s, datetime.fromisoformat(t)) for i, s, t in rows], "id long, symbol string, created_at timestamp")


def test_cooldown_edges(spark):
    p = posts(spark, (1, "A", "2024-01-01T00:00:00"), (2, "B", "2024-01-01T12:00:00"), (3, "C", "2024-01-02T01:00:00"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = {r.symbol: r for r in history.cooldown_tail(p, now).collect()}
    assert (rows["A"].hours_ago, rows["A"].blocked) == (24.0, False)
    assert (rows["B"].hours_ago, rows["B"].blocked) == (12.0, True)
    assert rows["C"].hours_ago == -1.0
    assert not any(r.blocked for r in history.cooldown_tail(p, now, catalyst="airdrop").collect())
    assert {r.symbol for r in history.cooldown_tail(p, now, n=1).collect()} == {"C"}


def test_blocked_posts_dont_restart_the_cooldown(spark):
    p = posts(spark, *[(i, "A", f"2024-01-0{1 + i // 2}T{12 * (i % 2):02d}:00:00") for i in range(6)])
    assert sorted(r.id for r in history.sequential_cooldown(p, 24).collect()) == [0, 2, 4]


def test_daily_cap(spark):
    p = posts(spark, *[(i, "A", f"2024-01-01T{i // 4:02d}:00:00") for i in range(30)], (50, "A", "2024-01-02T00:00:00"))
    assert sorted(r.id for r in history.within_cap(p, 8).collect()) == [*range(8), 50]
    assert {r.remaining for r in history.daily_cap(p, 8).collect()} == {0, 7}


def test_feeds(spark, tmp_path):
    (tmp_path / "market.json").write_text('[{"symbol": "sol", "name": "S", "current_price": 2, "market_cap": 5e9, "sparkline_in_7d": {"price": [1,2,3,4,5,6,7,8,9,10,11]}}, {"symbol": "x"}]')
    rows = {r.symbol: r for r in feeds.read_market(spark, str(tmp_path / "market.json")).collect()}
    assert rows["SOL"].history == [float(i) for i in range(2, 12)] and rows["X"].price == 0 and rows["X"].history == []
    (tmp_path / "info.json").write_text('{"symbols": [{"baseAsset": "a", "status": "TRADING", "isSpotTradingAllowed": true}, {"baseAsset": "b", "status": "BREAK", "isSpotTradingAllowed": true}, {"baseAsset": "A", "status": "TRADING", "isSpotTradingAllowed": true}]}')
    assert [r.symbol for r in feeds.read_listed(spark, str(tmp_path / "info.json")).collect()] == ["A"]
    (tmp_path / "ann.json").write_text('{"code": "000000", "data": {"catalogs": [{"catalogId": 48, "articles": [{"title": "T (AB)", "releaseDate": 1704067200000}, {"title": "U", "releaseDate": 1}]}, {"catalogId": 93, "articles": [{"title": "V", "releaseDate": 1}]}]}}')
    rows = feeds.read_announcements(spark, str(tmp_path / "ann.json"), per_catalog=1).collect()
    assert [(r.ann_type, r.impact, r.released_at) for r in rows] == [("new_listing", "high", datetime(2024, 1, 1))]
    (tmp_path / "rank.json").write_text('{"code": "000000", "rank_type": 30, "chain_id": "56", "data": {"tokens": [{"symbol": "ab", "price": "1.5", "marketCap": "bad", "metaInfo": {"name": "Ab"}}, {"symbol": " "}]}}')
    row = feeds.read_rank_lists(spark, str(tmp_path / "rank.json")).collect()
    assert [(r.source, r.symbol, r.name, r.price, r.market_cap, r.risk_level, r.smart_money_pct) for r in row] == [("smart_money", "AB", "Ab", 1.5, 0.0, 1, None)]
    (tmp_path / "trend.json").write_text('{"coins": [{"item": {"symbol": "q", "name": "Q", "score": 0}}, {"item": {"symbol": "r", "name": "R", "score": 1}}]}')
    assert feeds.read_trending(spark, str(tmp_path / "trend.json"), limit=1).collect()[0].symbol == "Q"
    (tmp_path / "tick.json").write_text('[{"symbol": "AUSDT", "lastPrice": "2", "quoteVolume": "10", "count": 5000}, {"symbol": "BEUR", "lastPrice": "2", "quoteVolume": "99", "count": 1}]')
    row = filters.quote_tickers(feeds.read_tickers(spark, str(tmp_path / "tick.json"))).collect()
    assert [(r.symbol, r.volume_ratio, r.market_cap) for r in row] == [("A", 5.0, 2e6)]
    (tmp_path / "candles.json").write_text('[["1","2","3","4","5.5","6"],["bad"],[1,2,3,4,7]]')
    assert [r.close_px for r in feeds.read_candles(spark, str(tmp_path / "candles.json")).orderBy("ord").collect()] == [5.5, 7.0]


def test_tables_and_records(spark, tmp_path):
    raw = spark.createDataFrame([({"text": "hi", "symbol": "A", "k": "v"},), ({"content": "c", "text": "t", "coin_symbol": "B"},), ({},)], "fields map<string,string>")
    assert [(r.content, r.coin_symbol, r.metadata) for r in feeds.post_record(raw).collect()] == [("hi", "A", '{"k":"v"}'), ("c", "B", "{}"), ("", None, "{}")]
    p = posts(spark, (1, "A", "2024-01-01T00:00:00"), (2, "B", "2024-01-02T00:00:00"))
    feeds.write_table(p, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("day = date'2024-01-02'").count() == 1
    old, new = p.withColumn("link", F.lit("x")), p.withColumns({"link": F.lit("x"), "image_url": F.lit("i")})
    assert sorted(r.image_url for r in feeds.reconciled(old, new).collect()) == ["", "", "i", "i"]
    both = feeds.else_fallback(p.where("symbol = 'A'"), p.withColumn("id", F.col("id") + 10), "symbol")
    assert sorted(r.id for r in both.collect()) == [1, 12]


def test_text(spark):
    assert value(spark, text.word_count(F.col("t")), t="") == 0
    assert value(spark, text.word_count(F.col("t")), t=" a b\n c ") == 3
    assert value(spark, text.hook_style(F.col("t")), t="\n\nSomething will MOON\nx") == "breakout_fomo"
    assert value(spark, text.hook_style(F.col("t")), t="a\nb\nc\nwhale") == "data_led"
    assert value(spark, text.setup_style(F.col("t")), t="Enter at 1, TP 2, SL 0.5") == "full_setup"
    five, six = " ".join(f"#t{i}" for i in range(5)), " ".join(f"#t{i}" for i in range(6))
    assert value(spark, text.limited_hashtags(F.col("t")), t="x " + five) == "x " + five
    assert value(spark, text.limited_hashtags(F.col("t")), t=f"x  y {six} z") == "x y z\n" + five
    known = F.array(*[F.lit(s) for s in ("ABC", "XYZ", "Q")])
    assert value(spark, text.title_symbols(F.col("t"), known), t="Will list (ABC), (ABC) and XYZ: not (Q) or (DEF)") == ["ABC", "ABC", "XYZ", "Q"]
    assert [value(spark, text.plain_number(F.lit(x).cast("double"))) for x in (1.5, 2.0, 0.000001, 100.0)] == ["1.5", "2", "0.000001", "100"]
    assert len(value(spark, text.signature(F.lit("a"), F.lit("b")))) == 16
    assert value(spark, text.compact_cap(F.lit(2.5e9))) == "$2.5B"


def test_rankings(spark):
    said = "RANK: 2\nCOIN: $ab: c\nREASON: one: two\nREASON: last\nRANK: 1st\nCOIN: XX\nRANK: 1\nREASON: r"
    rows = reports.parse_rankings(spark.createDataFrame([(1, said), (2, ""), (3, None)], "resp_id long, text string")).orderBy("place").collect()
    assert [(r.resp_id, r.place, r.rank, r.symbol, r.reason) for r in rows] == [(1, 1, 1, "", "r"), (1, 2, 2, "AB", "last")]


def test_rankings_are_parsed_where_they_lie(spark):
    """No response is taken apart into rows that are shuffled and sorted; what comes out is what a line by line reading gives."""
    import random

    rng = random.Random(3)
    line = lambda: rng.choice(["RANK: 2", "RANK:1", " RANK: x", "RANK:", "COIN: $ab", "COIN:", "COIN: c: d", "REASON: r:s ", "REASON:", "text", ""])
    said = [(i, "\n".join(line() for _ in range(rng.randrange(0, 14)))) for i in range(300)]
    want = []
    for i, body in said:
        blocks = []
        for x in map(lambda x: x.strip(" "), body.split("\n")):
            name, _, rest = x.partition(":")
            if x.startswith("RANK:"):
                blocks.append([rest.strip(), len(blocks), "", ""])
            elif x.startswith("COIN:") and blocks:
                blocks[-1][2] = rest.split(":")[0].strip().replace("$", "").upper()
            elif x.startswith("REASON:") and blocks:
                blocks[-1][3] = rest.strip()
        fine = sorted((int(r), n, coin, reason) for r, n, coin, reason in blocks if r.isdigit())
        want += [(i, place + 1, r, coin, reason) for place, (r, _, coin, reason) in enumerate(fine)]
    found = reports.parse_rankings(spark.createDataFrame(said, "resp_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 300
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not any(x in plan for x in ("Window", "Aggregate", "Sort"))


def test_topics_and_lookups(spark):
    dim = spark.createDataFrame([(0, "Robots", "R1"), (0, "Robots", "R2"), (1, "RoBo", "R3"), (2, "FUN", "F1")], "ord int, topic string, symbol string")
    t = spark.createDataFrame([("robots",), (" RoBo ",), ("FUN SEASON",), (" zzzz",), ("Z9",), ("too long a topic name",)], "topic string")
    got = {r.topic: r.assets for r in lookup.assets_of_topics(t, dim).collect()}
    assert got == {"robots": ["R1", "R2"], " RoBo ": ["R3"], "FUN SEASON": ["F1"], " zzzz": ["ZZZZ"], "Z9": [], "too long a topic name": []}
    strict = {r.topic: r.assets for r in lookup.assets_of_topics(t, dim, strict_case=True).collect()}
    assert strict["FUN SEASON"] == ["F1"] and strict["robots"] == ["ROBOTS"]
    rows = spark.createDataFrame([("R1",), ("F1",), ("NONE",)], "symbol string")
    assert {r.symbol: r.entry for r in lookup.first_entry(rows, dim, "topic", "").collect()} == {"R1": "Robots", "F1": "FUN", "NONE": ""}
    titles = spark.createDataFrame([(1, "An airdrop again"), (2, "New AI: listing")], "ann_id long, title string")
    assert {(r.ann_id, r.narrative) for r in lookup.narratives_in(titles, ("AI", "LISTING")).collect()} == {(1, "AI"), (2, "AI"), (2, "LISTING")}
    assert {(r.ann_id, r.narrative) for r in lookup.narratives_in(titles, ("AI", "LISTING"), whole_words=True).collect()} == {(2, "AI"), (2, "LISTING")}
    only = topics.standing(spark)
    assert topics.top_trending(only, 3).count() == 3
    mixed = only.unionByName(only.limit(1).withColumns({"source": F.lit("market"), "topic": F.lit(" ai ")}))
    assert [r.source for r in topics.top_trending(mixed, 3).collect()] == ["market"]
    merged = topics.merge(mixed)
    assert merged.count() == 9 and [r.source for r in merged.where("lower(trim(topic)) = 'ai'").collect()] == ["market"]
    assert {r.source: r.active for r in topics.provider_status(mixed).collect()} == {"announcement": False, "search": False, "market": True, "synthetic": True}


def test_routing(spark):
    rows = [("g1", "A", 80.0, "direct", None), ("g1", "B", 90.0, "direct", None), ("g1", "C", 70.0, "review", None), *[("g2", f"R{i}", 70.0 - i, "review", 1.0 if i < 2 else None) for i in range(7)], ("g3", "X", 10.0, "reject", None)]
    df = spark.createDataFrame(rows, "g string, symbol string, score double, decision string, hours_ago double")
    got = [(r.g, r.symbol, r.rank) for r in routing.route(df, "g").orderBy("g", "rank").collect()]
    assert got == [("g1", "B", 1), ("g2", "R2", 1), ("g2", "R3", 2), ("g2", "R4", 3)]


def test_upsert_of_every_metric(spark):
    p = posts(spark, (1, "A", "2024-01-01T00:00:00"), (2, "A", "2024-01-02T00:00:00")).withColumn("views", F.lit(None).cast("long"))
    p = p.withColumns({m: F.lit(7.0 if m == "reward" else 7) for m in reports.METRICS if m != "views"})
    u = spark.createDataFrame([("a", 5, None, 3, 0, 2.5)], "symbol string, new_views long, new_likes int, new_comments int, new_shares int, new_reward double")
    rows = {r.id: r.asDict() for r in reports.upsert_metrics(p, u).collect()}
    assert {m: rows[2][m] for m in reports.METRICS} == {"views": 5, "likes": 7, "comments": 3, "shares": 0, "traders": 7, "reward": 2.5}
    assert {rows[1][m] for m in reports.METRICS} == {None, 7}


def test_ranks_and_neighbours_by_buckets(spark):
    """Buckets give what one window would."""
    rows = [(i % 3, (i * 7) % 11, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, a int, b int").repartition(5)
    got = {(r.g, r.a, r.b): r.place for r in ordering.ranked(df, ["g"], {"x": F.floor(F.col("a") / 4)}, ["a", "b"], "place").collect()}
    for g in range(3):
        own = sorted(r for r in rows if r[0] == g)
        assert [got[r] for r in own] == list(range(1, len(own) + 1))
    for after in (False, True):
        near = {(r.g, r.a, r.b): r.near for r in ordering.neighbour(df, "g", F.floor(F.col("a") / 5), ["a", "b"], "b", "near", after=after).collect()}
        for g in range(3):
            own = sorted(r for r in rows if r[0] == g)
            want = [r[2] for r in own]
            assert [near[r] for r in own] == ([*want[1:], None] if after else [None, *want[:-1]])


def test_numbers_as_text(spark):
    cases = [(1.25, 1, "1.3"), (-0.04, 1, "0.0"), (-0.05, 1, "-0.1"), (1234.5, 0, "1235"), (0.000001, 6, "0.000001"), (99.9999996, 6, "100.000000")]
    assert [value(spark, text.fixed(F.lit(x), d)) for x, d, _ in cases] == [t for *_, t in cases]
    assert [value(spark, text.clipped(F.lit(t).cast("string"), 3)) for t in ("abcd", "ab", None)] == ["abc", "ab", ""]


def test_posts_within_hours(spark):
    p = posts(spark, (1, "A", "2024-01-01T00:00:00"), (2, "B", "2024-01-01T12:00:00"), (3, "C", "2024-01-02T01:00:00"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert [r.id for r in history.newest(p, 5, now, 24).collect()] == [2, 1] and [r.id for r in history.newest(p, 5, now, 12).collect()] == [2]


def test_upsert_changes_only_given_columns(spark):
    p = posts(spark, (1, "A", "2024-01-01T00:00:00"), (2, "A", "2024-01-02T00:00:00"), (3, "B", "2024-01-02T00:00:00")).withColumns({"views": F.lit(None).cast("long"), "traders": F.lit(7).cast("long")})
    u = spark.createDataFrame([("A", 5, None)], "symbol string, new_views long, new_traders long")
    assert {r.id: (r.views, r.traders) for r in reports.upsert_metrics(p, u).collect()} == {1: (None, 7), 2: (5, 7), 3: (None, 7)}


def test_history_line(spark):
    flat = value(spark, research.linear_history(F.lit(2.0), F.lit(0.001)))
    assert flat == [2.0] * 10
    line = value(spark, research.linear_history(F.lit(2.0), F.lit(100.0)))
    assert line[0] == 1.0 and line[-1] == 2.0 and len(line) == 10


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i % 3, f"s{i % 10}", float(i % 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, symbol string, score double")
    one = filters.top_by(df.repartition(1), "g", 3, F.desc("score"), F.col("symbol")).collect()
    many = filters.top_by(df.repartition(9), "g", 3, F.desc("score"), F.col("symbol")).collect()
    assert sorted(one) == sorted(many)
