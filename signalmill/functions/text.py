"""Text features of posts and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hook styles by words in the first lines, first match wins: fixed values.
HOOKS = (
    ("breakout_fomo", ("🚀", "explod", "surge", "pump", "blast", "moon")),
    ("warning_alert", ("⚠️", "warning", "crash", "dump", "plunge")),
    ("smart_money", ("whale", "smart money", "accum", "buying")),
    ("listing_news", ("listing", "launchpool", "airdrop", "new on binance")),
    ("narrative_driven", ("ai", "narrative", "sector")),
    ("question_hook", ("?",)),
    ("trade_setup", ("entry", "target", "setup", "🛑")),
)
#: Words of a trade setup: fixed values.
ENTRY, TARGET, STOP = ("entry", "enter"), ("target", "tp", "🎯"), ("stop", "🛑", "sl")


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("#[A-Za-z0-9_]+"), F.lit(0))


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\$[A-Za-z0-9_\\u4e00-\\u9fff]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for empty text."""
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""))


def hook_style(text: Column) -> Column:
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != ""), 1, 3)
    head = F.array_join(lines, "\n")
    out = F.lit("data_led")
    for style, words in reversed(HOOKS):
        out = F.when(contains_any(head, words), style).otherwise(out)
    return out


def setup_style(text: Column) -> Column:
    low = F.lower(text)
    entry, target, stop = (contains_any(low, w) for w in (ENTRY, TARGET, STOP))
    return F.when(entry & target & stop, "full_setup").when(entry & target, "entry_target").when(target, "target_only").otherwise("analysis_only")


def limited_hashtags(text: Column, most: int = 5) -> Column:
    """Texts with more hashtags get the first ones on a last line of their own."""
    tags = hashtags(text)
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "#[A-Za-z0-9_]+", ""), " +", " "))
    return F.when(F.size(tags) > most, F.concat(bare, F.lit("\n"), F.array_join(F.slice(tags, 1, most), " "))).otherwise(text)


def title_words(title: Column) -> Column:
    """Words without the punctuation around them."""
    return F.transform(F.split(title, "(?U)\\s+"), lambda w: F.regexp_replace(w, "^[.,:;!?()\\[\\]{}]+|[.,:;!?()\\[\\]{}]+$", ""))


def title_symbols(title: Column, known: Column) -> Column:
    """Known symbols in parentheses, repeats kept, then known words that weren't among them."""
    marked = F.filter(F.regexp_extract_all(title, F.lit("\\(([A-Z0-9]{2,10})\\)"), F.lit(1)), lambda s: F.array_contains(known, s))
    plain = F.array_distinct(F.filter(title_words(title), lambda w: F.array_contains(known, w)))
    return F.concat(marked, F.array_except(plain, marked))


def signature(*columns: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the fields joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16)


def clipped(text: Column, most: int) -> Column:
    """The first ``most`` characters; empty for null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, rounded half up by its size."""
    scaled = F.floor(F.abs(value) * 10.0**digits + 0.5).cast("long")
    sign = F.when((value < 0) & (scaled > 0), "-").otherwise("")
    if not digits:
        return F.concat(sign, scaled.cast("string"))
    unit = F.lit(10**digits).cast("long")
    return F.concat(sign, F.floor(scaled / unit).cast("long").cast("string"), F.lit("."), F.lpad((scaled % unit).cast("string"), digits, "0"))


def plain_number(value: Column) -> Column:
    """Six decimals without trailing zeros or point."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", ""), "\\.$", "")


def compact_cap(value: Column) -> Column:
    return F.when(value >= 1e9, F.concat(F.lit("$"), F.format_number(value / 1e9, 1), F.lit("B"))).otherwise(F.concat(F.lit("$"), F.format_number(value / 1e6, 1), F.lit("M")))


def shown_price(value: Column) -> Column:
    return F.when(value < 100, F.format_number(value, 4)).otherwise(F.format_number(value, 2))
