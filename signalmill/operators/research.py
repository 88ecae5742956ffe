"""Price patterns and classification columns of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.numbers import tiers
from signalmill.functions.text import fixed
from signalmill.operators.ordering import neighbour

c = F.col


def recent_points(ticks: DataFrame, n: int) -> DataFrame:
    """The last n closes of each symbol, oldest first, as an array."""
    order = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    last = ticks.withColumn("back", F.row_number().over(order)).where(c("back") <= n)
    return last.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct((-c("back")).alias("at"), "close_px"))), lambda x: x["close_px"]).alias("points"))


def price_pattern(assets: DataFrame) -> DataFrame:
    """trend, strength, pattern and volatility from the last five points; neutral with fewer."""
    p, change = c("points"), c("change_24h")
    first, last = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(-1))
    enough = F.coalesce(F.size(p) >= 5, F.lit(False))
    up, down = enough & (last > first * 1.05), enough & (last < first * 0.95)
    rise = F.coalesce(F.try_divide(last, first) - 1, F.lit(0.0))
    low = F.array_min(p)
    spread = F.when(low > 0, F.try_divide(F.array_max(p), low) - 1).otherwise(0.05)
    return assets.withColumns({
        "trend": F.when(up, "bullish").when(down, "bearish").otherwise("neutral"),
        "strength": F.when(up, F.least(F.lit(1.0), rise * 5)).when(down, F.least(F.lit(1.0), F.abs(rise) * 3)).otherwise(0.5),
        "pattern": F.when(~enough, "").when(up, F.when(change > 5, "breakout").otherwise("steady uptrend")).when(down, F.when(change < -5, "sharp selloff").otherwise("gradual distribution"))
        .when(F.abs(change) < 2, "ranging").when(change > 0, "upward bias").otherwise("downward bias"),
        "volatility": F.when(~enough, "medium").when(spread > 0.08, "high").when(spread > 0.03, "medium").otherwise("low"),
    })


def scaled_series(ticks: DataFrame) -> DataFrame:
    """Closes scaled to their symbol's range (0 to 1; a flat series counts as range 1), and the next
    step's direction. The range is a partial aggregate joined back."""
    span = ticks.groupBy("symbol").agg(F.min("close_px").alias("low"), F.max("close_px").alias("high"))
    width = F.when(c("high") > c("low"), c("high") - c("low")).otherwise(1.0)
    out = neighbour(ticks, "symbol", F.year("ts"), ["ts", "l_orderkey", "l_linenumber"], "close_px", "next", after=True).join(span, "symbol")
    return out.select("symbol", "l_orderkey", "l_linenumber", ((c("close_px") - c("low")) / width).alias("scaled"), F.when(c("next").isNull(), "last").when(c("next") >= c("close_px"), "up").otherwise("down").alias("step"))


def linear_history(price: Column, change: Column, points: int = 10) -> Column:
    """Points on a line from the price before the change to the price; flat for a change under 0.01."""
    start = F.coalesce(F.try_divide(price, 1 + change / 100), price)
    flat = (F.abs(change) < 0.01) | (1 + change / 100 <= 0)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(flat, price).otherwise(start + (price - start) * i / (points - 1)))


#: Factors of the trade levels: fixed values.
LEVELS = {"entry": 1.002, "target1": 1.08, "target2": 1.16, "stop": 0.94}


def trade_levels(price: Column) -> dict[str, Column]:
    return {k: price * f for k, f in LEVELS.items()}


def volume_verdict(ratio: Column) -> Column:
    return F.when(ratio > 2, "exceptional").when(ratio > 1.5, "above average").when(ratio < 0.5, "very thin").when(ratio < 1, "below average").otherwise("normal")


def thin_market(volume: Column, cap: Column) -> Column:
    return (cap > 0) & (F.coalesce(F.try_divide(volume, cap), F.lit(0.0)) < 0.01)


def risk_factors() -> Column:
    price, cap, ratio, change = c("price"), c("market_cap"), c("volume_ratio"), c("change_24h")
    found = F.filter(
        F.array(
            F.when(price < 0.1, "micro price").when(price < 1, "low price"), F.when((cap > 0) & (cap < 1e7), "small cap"), F.when(ratio < 0.8, "thin volume"),
            F.when(F.abs(change) > 20, "extreme move"), F.when(c("category") == "MEME", "meme asset"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("standard risk")))


def risk_level(factors: Column) -> Column:
    points = F.size(factors) + F.when(c("price") < 0.1, 1).otherwise(0) + F.when(F.abs("change_24h") > 15, 1).otherwise(0)
    return F.when(points >= 3, "high").when(points >= 1, "medium").otherwise("low")


def market_context(change: Column) -> Column:
    return F.when(change > 8, "strongly bullish").when(change > 3, "positive").when(change > 0, "mildly bullish").when(change > -3, "slightly bearish").when(change > -8, "bearish").otherwise("capitulation")


def research_flags(assets: DataFrame) -> DataFrame:
    """Stage, freshness, volume level, interest, tradability, repetition and move detail. Columns:
    price, market_cap, change_24h, volume_ratio, category, catalyst (null: none), hours_ago (null: never)."""
    size, ratio = F.abs(c("change_24h")), c("volume_ratio")
    return assets.withColumns({
        "stage": F.when((size < 3) & (ratio < 2), "EARLY").when(size < 8, "FRESH").when(size < 15, "ONGOING").otherwise("LATE"),
        "freshness": F.when(c("category") == "", "UNKNOWN").when(c("category").isin("AI", "MEME", "L1"), "HIGH").when(c("category").isin("RWA", "DePIN", "GAMING"), "GROWING").otherwise("STABLE"),
        "volume_level": tiers(ratio, ((3.0, "EXTREME"), (2.0, "HIGH"), (1.5, "ELEVATED")), "NORMAL"),
        "interest": F.when(c("catalyst").isNotNull() | (size > 5), "HIGH").when(ratio > 2, "MEDIUM").otherwise("LOW"),
        "tradable": F.when((c("price") > 0.1) & (c("market_cap") > 1e7), "YES").when((c("price") > 0.01) & (c("market_cap") > 1e6), "POSSIBLE").otherwise("NO"),
        "repetition": F.when(c("hours_ago").isNull(), "NEVER").when(c("hours_ago") < 24, "HIGH").when(c("hours_ago") < 48, "MEDIUM").otherwise("LOW"),
        "move_detail": F.when(c("catalyst").isNotNull(), "catalyst").when(size > 8, "explosive").when(size > 4, "strong").otherwise("gradual"),
        "volume_confirms": c("catalyst").isNull() & (ratio > 2.5),
    })


def why_now() -> Column:
    """Up to three reasons to act, in order."""
    found = F.filter(
        F.array(
            F.when(c("catalyst").isNotNull(), F.concat(c("catalyst"), F.lit(" catalyst"))), F.when(F.abs("change_24h") > 5, "strong move"),
            F.when(c("volume_ratio") > 2, "volume confirms"), F.when(c("category") != "", F.concat(c("category"), F.lit(" narrative"))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(F.array(F.lit("setup developing")))


def _signed(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, 1), F.lit("%"))


def risk_note() -> Column:
    """A line on the risk level and the first factor."""
    factors = risk_factors()
    return F.concat(F.initcap(risk_level(factors)), F.lit(" risk: "), F.get(factors, F.lit(0)), F.lit("."))


def thesis(assets: DataFrame) -> DataFrame:
    """bull_case, bear_case, reason and risk_note texts from the pattern, volume, move, size and category."""
    change, ratio = c("change_24h"), c("volume_ratio")
    join = lambda *parts: F.concat_ws(" ", *parts)  # noqa: E731  nulls are left out
    return assets.withColumns({
        "bull_case": join(
            F.when(c("trend") == "bullish", F.when(c("strength") > 0.6, "The chart is strong.").otherwise("The chart is improving.")),
            F.when(ratio > 1.5, "Volume supports the move."),
            F.when(change > 5, "The pace may carry on.").when(change > 0, "Buyers build up slowly.").otherwise("Oversold assets tend to find buyers."),
            F.when(c("category") != "", F.concat(F.lit("The "), c("category"), F.lit(" narrative gains ground."))),
        ),
        "bear_case": join(
            F.when(c("trend") == "bearish", "The chart weakens."), F.when(ratio < 1, "Volume is thin."),
            F.when(c("market_cap") > 1e11, "Large assets move slowly.").when(change < -5, "The downtrend holds.").otherwise("The pace may fade without volume."),
        ),
        "reason": join(
            F.when(c("catalyst").isNotNull(), F.concat(c("symbol"), F.lit(" has a "), c("catalyst"), F.lit(" announcement."))),
            F.concat(c("symbol"), F.lit(" moved "), _signed(change), F.lit(" at "), fixed(ratio, 1), F.lit("x volume.")),
            F.when(c("pattern") != "", F.concat(F.lit("Pattern: "), c("pattern"), F.lit("."))),
        ),
        "risk_note": risk_note(),
    })


def research_package(assets: DataFrame) -> DataFrame:
    """One text per asset from its classification columns, a section to a line group."""
    row = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    text = F.concat_ws(
        "\n", row("ASSET", F.concat(c("symbol"), F.lit(" ("), c("name"), F.lit(")"))), F.lit("-- MARKET --"), row("Price", fixed(c("price"), 6)), row("Change", _signed(c("change_24h"))),
        row("Volume", F.concat(fixed(c("volume_24h"), 0), F.lit(", "), fixed(c("volume_ratio"), 1), F.lit("x"))), row("Market cap", fixed(c("market_cap"), 0)),
        F.lit("-- CATALYST --"), row("Type", F.upper(F.coalesce("catalyst", F.lit("market movement")))), row("Detail", c("move_detail")),
        F.lit("-- TIMING --"), row("Stage", c("stage")), F.lit("-- NARRATIVE --"), row("Sector", F.coalesce(F.nullif(c("category"), F.lit("")), F.lit("NONE"))), row("Freshness", c("freshness")),
        F.lit("-- VOLUME --"), row("Level", c("volume_level")), F.lit("-- AUDIENCE --"), row("Interest", c("interest")), F.lit("-- TRADING --"), row("Ready", c("tradable")),
        F.lit("-- RISK --"), row("Level", F.upper("risk")), row("Factors", F.array_join("factors", "; ")), F.lit("-- REPETITION --"), row("Risk", c("repetition")), F.lit("-- WHY NOW --"), F.array_join("why", "\n"),
    )
    return assets.withColumn("package", text)


def tone(change: Column, ratio: Column) -> Column:
    return F.when((change > 5) & (ratio > 1.5), "FOMO Bull").when(change < -3, "Panic Bear").otherwise("Cold Analyst")


def headline_class(catalyst: Column, category: Column) -> Column:
    size, ratio = F.abs(c("change_24h")), c("volume_ratio")
    return (
        F.when(catalyst == "new_listing", "listing").when(catalyst == "airdrop", "airdrop").when(size >= 10, "breakout").when(size >= 5, "momentum").when(size >= 3, "traction")
        .when(ratio >= 3, "volume spike").when(ratio >= 2, "volume surge").when(category == "AI", "ai").when(category == "MEME", "meme").when(c("change_24h") <= 0, "discount").otherwise("trend")
    )


def wording(options: list[str], key: Column) -> Column:
    """One of the wordings, by the key's hash: the same for the same key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(key), F.lit(len(options))) + 1).cast("int"))


def card_reasons(catalyst: Column, category: Column, score: Column, hot: Column) -> Column:
    """Three to five reasons for a card, as codes."""
    size, ratio = F.abs(c("change_24h")), c("volume_ratio")
    found = F.filter(
        F.array(
            tiers(size, ((10.0, "explosive move"), (5.0, "strong move"), (3.0, "trending")), "notable action"), tiers(ratio, ((3.0, "volume spike"), (2.0, "high volume"), (1.5, "healthy volume")), ""),
            F.when(category != "", F.concat(category, F.lit(" narrative"))).otherwise(""), F.when(catalyst.isNotNull(), F.concat(catalyst, F.lit(" announcement"))).otherwise(""),
            F.when(score > 70, "elite score").when(hot > 5, "hot search").otherwise(""),
        ),
        lambda x: x != "",
    )
    padded = F.concat(found, F.slice(F.array(F.lit("market structure"), F.lit("indicators aligned")), 1, F.greatest(3 - F.size(found), F.lit(0))))
    return F.slice(padded, 1, 5)


#: Symbols of card templates: fixed values.
TEMPLATE_SYMBOLS = {"ai_narrative": ("fetch", "agix", "tao", "rndr", "near"), "meme": ("doge", "shib", "pepe", "wif"), "defi": ("aave", "uni", "link", "mkr")}


def template(catalyst: Column, narrative: Column, symbol: Column, ratio: Column) -> Column:
    low, sym = F.lower(narrative), F.lower(symbol)
    return (
        F.when(catalyst.isin("new_listing", "airdrop", "launchpool"), "listing").when(catalyst == "delisting", "breakout")
        .when(F.contains(low, F.lit("ai")) | sym.isin(*TEMPLATE_SYMBOLS["ai_narrative"]), "ai_narrative").when(F.contains(low, F.lit("meme")) | sym.isin(*TEMPLATE_SYMBOLS["meme"]), "meme")
        .when(F.contains(low, F.lit("defi")) | sym.isin(*TEMPLATE_SYMBOLS["defi"]), "defi").when(F.contains(low, F.lit("rwa")), "narrative").when(ratio > 3, "breakout").otherwise("default")
    )


def badges(penalty: Column, score: Column, override: Column) -> tuple[Column, Column]:
    """Risk and confidence badges of a card."""
    return F.when(penalty > 5, "HIGH").when(penalty > 2, "MEDIUM").otherwise("LOW"), F.when(override, "LOW").when(score < 60, "MEDIUM").otherwise("HIGH")


