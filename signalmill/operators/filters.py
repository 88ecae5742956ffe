"""Universe filters and the reject cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from signalmill.functions.numbers import clamp
from signalmill.operators.history import EXCEPTIONAL, HARD_HOURS, SOFT_HOURS, WEAK_HOURS

#: Symbols posted only for an exceptional catalyst or a large move: fixed values.
TOP_FIVE = ("BTC", "ETH", "BNB", "SOL", "XRP")


def volume_ratio_market(volume: Column, cap: Column) -> Column:
    return clamp(volume / F.greatest(cap, F.lit(1.0)) * 100, 0.3, 10.0)


def volume_ratio_rank(volume: Column, cap: Column) -> Column:
    return F.when(cap > 0, F.least(volume / F.greatest(cap, F.lit(1.0)) * 5, F.lit(5.0))).otherwise(1.0)


def moves(change: Column, ratio: Column) -> Column:
    return (F.abs(change) > 2.5) | (ratio > 1.5)


def universe(assets: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed assets with a price, a known cap of a million or more, and a change within 100 %."""
    fine = (F.col("price") > 0) & (F.col("market_cap") >= 1e6) & (F.abs("change_24h") <= 100)
    return assets.where(fine).join(listed, "symbol", "left_semi")


def quote_tickers(tickers: DataFrame, quote: str = "USDT", n: int = 12) -> DataFrame:
    """The n pairs against ``quote`` with most volume, as assets."""
    base = F.expr(f"substring(symbol, 1, length(symbol) - {len(quote)})")
    pairs = tickers.where(F.col("symbol").endswith(quote) & (F.col("price") > 0)).orderBy(F.desc("volume_24h"), "symbol").limit(n)
    return pairs.select(
        base.alias("symbol"), "price", "change_24h", "volume_24h",
        F.greatest(F.lit(1.0), F.col("trades") / 1000).alias("volume_ratio"), F.greatest(F.col("volume_24h") * 10, F.col("price") * 1e6).alias("market_cap"),
    )


def volume_spikes(assets: DataFrame, threshold: float = 1.75) -> DataFrame:
    return assets.where(F.col("volume_ratio") >= threshold)


def reject_reason(from_hub: bool = True, hard: float = HARD_HOURS, soft: float = SOFT_HOURS, top: tuple = TOP_FIVE) -> Column:
    """The first rule that an asset fails, or null. Columns: symbol, price, market_cap, change_24h,
    liquidity, risk_level, volume_ratio, catalyst (null: none), hours_ago (null: never), listed."""
    c, size = F.col, F.abs(F.col("change_24h"))
    exceptional = F.coalesce(c("catalyst").isin(*EXCEPTIONAL), F.lit(False))
    cooling = c("hours_ago").isNotNull() & ~exceptional
    least_price, least_cap = (1e-4, 1e5) if from_hub else (1e-2, 5e5)
    return (
        F.when(F.coalesce(c("symbol"), F.lit("")) == "", "empty symbol")
        .when((c("price") <= 0) | (c("price") < least_price), "price too low")
        .when((c("market_cap") > 0) & (c("market_cap") < least_cap), "market cap too low")
        .when(size > 150, "extreme move")
        .when((c("liquidity") > 0) & (c("liquidity") < 1e4), "liquidity too low")
        .when(c("risk_level") >= 3, "high risk")
        .when(c("catalyst").isNull() & ~moves(c("change_24h"), c("volume_ratio")), "no catalyst")
        .when(cooling & (c("hours_ago") < hard), "hard cooldown")
        .when(cooling & (c("hours_ago") < soft), "soft cooldown")
        .when(cooling & (c("hours_ago") < WEAK_HOURS) & (size < 5), "weak move in cooldown")
        .when(~c("listed"), "not listed")
        .when(c("symbol").isin(*top) & (~exceptional | (size < 5)), "top symbol without reason")
    )


def enriched(assets: DataFrame, catalysts: DataFrame, ages: DataFrame, listed: DataFrame) -> DataFrame:
    """Assets with catalyst (symbol, catalyst), hours_ago and listed."""
    return (
        assets.join(catalysts.select("symbol", "catalyst"), "symbol", "left").join(ages.select("symbol", "hours_ago"), "symbol", "left")
        .join(listed.select("symbol", F.lit(True).alias("listed")).distinct(), "symbol", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    )


#: What the reject cascade may say.
OUTCOMES = (
    "passed", "empty symbol", "price too low", "market cap too low", "extreme move", "liquidity too low", "high risk", "no catalyst", "hard cooldown", "soft cooldown", "weak move in cooldown",
    "not listed", "top symbol without reason",
)


def write_candidates(assets: DataFrame, path: str, top: tuple = TOP_FIVE) -> dict[str, int]:
    """Write the assets that no rule rejects. How many came to which end is observed in the same pass."""
    seen = Observation("funnel")
    outcome = F.coalesce("reason", F.lit("passed"))
    judged = assets.withColumn("reason", reject_reason(top=top)).observe(seen, *[F.count_if(outcome == o).alias(o) for o in OUTCOMES])
    judged.where("reason is null").drop("reason").write.parquet(path)
    return {o: n for o, n in seen.get.items() if n}


def large_groups(rows: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Rows of the groups with enough of them: counted first, then joined."""
    big = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(group)
    return rows.join(big, group, "left_semi")


def top_by(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
