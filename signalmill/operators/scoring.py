"""Rank list merge, component scores and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.numbers import clamp, tenths, tiers
from signalmill.operators.ordering import ranked

#: Weights of the metrics: fixed values.
WEIGHTS = {"trending": 0.20, "smart_money": 0.20, "top_search": 0.15, "volume": 0.15, "market_cap": 0.10, "liquidity": 0.10, "momentum": 0.05, "quality": 0.05}
DIRECT, REVIEW = 75.0, 60.0


def merge_feed(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per symbol of rank list rows (rank_type, source, chain_id, symbol): the first record's ``fields``,
    the list of sources in feed order, how many, and how many are distinct."""
    order = F.array_sort(F.collect_list(F.struct("rank_type", "chain_id", "source")))
    first = F.min_by(F.struct(*fields), F.struct("rank_type", "chain_id")) if fields else F.lit(None)
    return (
        rows.groupBy("symbol").agg(order.alias("feed"), first.alias("first"))
        .select("symbol", *[F.col(f"first.{f}").alias(f) for f in fields], F.transform("feed", lambda x: x["source"]).alias("sources"), F.size("feed").alias("n_entries"))
        .withColumn("n_sources", F.size(F.array_distinct("sources")))
    )


def feed_positions(rows: DataFrame, place: str) -> DataFrame:
    """Position of each row in its list, in the order of a whole-number column. Lists are few and long, so they
    are ranked by ranges of it."""
    return ranked(rows, ["rank_type", "chain_id"], {"range": F.floor(F.col(place) / 4096)}, [place], "position")


def components(assets: DataFrame) -> DataFrame:
    """c_<metric> (0 to 100) and a_<metric> (is it known) of assets with sources, n_sources, tagged,
    smart_money_pct, volume_24h, market_cap, liquidity and change_24h."""
    c = F.col
    has = lambda s: F.array_contains("sources", s)
    pct = F.coalesce("smart_money_pct", F.lit(0.0))
    scores = {
        "trending": F.when(has("trending"), 100.0).otherwise(0.0),
        "smart_money": F.least(pct * 10, F.lit(100.0)),
        "top_search": F.when(has("top_search"), 100.0).otherwise(0.0),
        "volume": F.least(F.coalesce(F.try_divide("volume_24h", "market_cap"), F.lit(0.0)) * 500, F.lit(100.0)),
        "market_cap": F.when(c("market_cap") > 0, tiers(c("market_cap"), ((1e9, 100.0), (1e8, 80.0), (1e7, 60.0), (1e6, 40.0)), 20.0)).otherwise(0.0),
        "liquidity": F.when(c("liquidity") > 0, tiers(c("liquidity"), ((1e6, 100.0), (1e5, 80.0), (1e4, 60.0)), 40.0)).otherwise(0.0),
        "momentum": tiers(F.abs("change_24h"), ((20.0, 100.0), (10.0, 80.0), (5.0, 60.0), (2.0, 40.0)), 20.0),
        "quality": F.least(F.least(25.0 * c("n_sources"), F.lit(100.0)) + F.when(c("tagged"), 20.0).otherwise(0.0), F.lit(100.0)),
    }
    known = {"smart_money": has("smart_money") | (pct > 0), "volume": (c("volume_24h") > 0) & (c("market_cap") > 0), "market_cap": c("market_cap") > 0, "liquidity": c("liquidity") > 0}
    return assets.withColumns({f"c_{k}": v for k, v in scores.items()} | {f"a_{k}": known.get(k, F.lit(True)) for k in scores})


def weighted_score(scored: DataFrame) -> DataFrame:
    """score: the components' mean by weight over those that are known, with bonuses and penalties."""
    c = F.col
    has = lambda s: F.array_contains("sources", s)
    total = weight = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + F.when(c(f"a_{k}"), c(f"c_{k}") * w).otherwise(0.0)
        weight = weight + F.when(c(f"a_{k}"), w).otherwise(0.0)
    bonus = F.when(c("n_sources") >= 3, 5.0).otherwise(0.0)
    for s in ("trending", "top_search", "smart_money", "alpha"):
        bonus = bonus + F.when(has(s), 5.0).otherwise(0.0)
    risk = F.coalesce("risk_level", F.lit(1))
    factor = F.when(risk >= 3, 0.5).when(risk == 2, 0.8).otherwise(1.0)
    cheap = F.when((c("price") > 0) & (c("price") < 1e-4), 0.3).when((c("price") > 0) & (c("price") < 1e-3), 0.6).otherwise(1.0)
    return scored.withColumn("score", tenths(clamp((F.coalesce(F.try_divide(total, weight), F.lit(0.0)) + bonus) * factor * cheap, 0.0, 100.0)))


def decision(score: Column) -> Column:
    return F.when(score >= DIRECT, "direct").when(score >= REVIEW, "review").otherwise("reject")


def heuristic_score(change: Column, ratio: Column) -> Column:
    return F.least(F.abs(change) * 3 + ratio * 10, F.lit(100.0))


def priority_score(change: Column, ratio: Column, cap: Column, category: Column) -> Column:
    bonus = F.when(category == "AI", 2.0).when(category == "MEME", 1.5).when(category == "L1", 1.0).otherwise(0.0)
    market = clamp(change, -5.0, 5.0) * 0.3 + F.least(F.lit(5.0), ratio * 1.5) * 0.3
    return F.greatest(market + F.least(F.lit(3.0), cap / 1e11) * 0.2 + (F.abs(change) / 10 + ratio / 2) * 0.2 + bonus, F.lit(0.0))


def momentum_score(change: Column, ratio: Column, cap: Column) -> Column:
    return clamp(change, -10.0, 10.0) + F.least(F.lit(10.0), ratio * 3) - F.when(cap <= 0, 2.0).otherwise(0.0)
