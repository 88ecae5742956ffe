"""Post history: cleaning, ages, cooldowns and daily caps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from signalmill.functions.numbers import hours_between
from signalmill.operators.ordering import neighbour

#: Catalysts that no cooldown blocks: fixed values.
EXCEPTIONAL = ("new_listing", "launchpool", "megadrop", "airdrop", "delisting")
HARD_HOURS, SOFT_HOURS, WEAK_HOURS, DAILY_CAP = 12.0, 24.0, 48.0, 8


def symbol_of(c: Column | str) -> Column:
    return F.upper(F.trim(c))


def clean_history(lines: DataFrame) -> DataFrame:
    """Valid lines of a post history with symbol upper-cased and time parsed; an offset in the time is
    converted to UTC. Lines that are no objects, or lack a symbol or a readable time, are left out."""
    return (
        lines.withColumns({"symbol": symbol_of("symbol"), "created_at": F.try_to_timestamp("timestamp")})
        .where((F.col("symbol") != "") & F.col("created_at").isNotNull()).drop("timestamp", "_corrupt_record")
    )


def is_valid() -> Column:
    """Whether a line has a symbol and a readable time."""
    return F.coalesce((symbol_of("symbol") != "") & F.try_to_timestamp("timestamp").isNotNull(), F.lit(False))


def write_clean(lines: DataFrame, path: str) -> dict[str, int]:
    """Write the valid lines of a history as a table. Their number and that of the others come with the writing: they are
    observed as the lines pass, so the lines are read once."""
    seen = Observation("audit")
    counted = lines.observe(seen, F.count_if(is_valid()).alias("n_valid"), F.count_if(~is_valid()).alias("n_corrupt"))
    clean_history(counted).write.parquet(path)
    return seen.get


def hours_since(posts: DataFrame, as_of: Column) -> DataFrame:
    """Hours from each symbol's newest post to as_of."""
    return posts.where("symbol is not null").groupBy("symbol").agg(F.max("created_at").alias("newest")).select("symbol", hours_between(F.col("newest"), as_of).alias("hours_ago"))


def merge_ages(one: DataFrame, other: DataFrame) -> DataFrame:
    """The smaller age of each symbol."""
    return one.unionByName(other).groupBy("symbol").agg(F.min("hours_ago").alias("hours_ago"))


def newest(posts: DataFrame, n: int, as_of: Column | None = None, within_hours: float | None = None) -> DataFrame:
    """The last n posts by id; with ``within_hours`` only those of so many hours before ``as_of``."""
    if within_hours is not None:
        posts = posts.where(hours_between(F.col("created_at"), as_of).between(0, within_hours))
    return posts.orderBy(F.desc("id")).limit(n)


def blocked(catalyst: Column, hours_ago: Column, hard: float = HARD_HOURS, soft: float = SOFT_HOURS) -> Column:
    return ~catalyst.isin(*EXCEPTIONAL) & (hours_ago < max(hard, soft))


def cooldown_tail(posts: DataFrame, as_of: Column, n: int = 50, catalyst: str = "market_move") -> DataFrame:
    """Of the symbols in the last n log lines: the newest one's age, and if it blocks a new post."""
    ages = hours_since(newest(posts, n), as_of)
    return ages.withColumn("blocked", blocked(F.lit(catalyst), F.col("hours_ago")))


def gaps(posts: DataFrame) -> DataFrame:
    """Hours between a post and its symbol's previous one."""
    timed = neighbour(posts.where("symbol is not null"), "symbol", F.to_date("created_at"), ["created_at", "id"], "created_at", "before")
    return timed.where("before is not null").select("id", "symbol", hours_between(F.col("before"), F.col("created_at")).alias("gap_hours"))


def daily_cap(posts: DataFrame, cap: int = DAILY_CAP) -> DataFrame:
    """Posts of each day and how many the cap still admits."""
    n = posts.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_posts"))
    return n.withColumn("remaining", F.greatest(F.lit(cap) - F.col("n_posts"), F.lit(0)).cast("long"))


def within_cap(posts: DataFrame, cap: int = DAILY_CAP) -> DataFrame:
    """The first ``cap`` posts of each day. Counted per (day, hour) first, so that only the hours that
    the cap cuts through are ranked."""
    timed = posts.withColumns({"day": F.to_date("created_at"), "hour": F.hour("created_at")})
    hours = timed.groupBy("day", "hour").agg(F.count("*").alias("n"))
    before = hours.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reached = timed.join(before.where(F.col("before") < cap).drop("n"), ["day", "hour"])
    rank = F.row_number().over(Window.partitionBy("day", "hour").orderBy("created_at", "id"))
    return reached.where(F.col("before") < cap).withColumn("rank", rank).where(F.col("before") + F.col("rank") <= cap).drop("hour", "before", "rank")


def admit(times: np.ndarray, last: int | None, gap: int) -> tuple[np.ndarray, int | None]:
    """Which of one symbol's sorted post times (microseconds) a cooldown lets through, and the last that it did.
    Only an admitted post starts a new cooldown, so each decision hangs on those before it; the next one is
    found by bisection."""
    ok = np.zeros(len(times), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(times, last + gap))
    while i < len(times):
        ok[i], last = True, int(times[i])
        i = max(i + 1, int(np.searchsorted(times, last + gap)))
    return ok, last


def micros(hours: float) -> int:
    return round(hours * 3_600_000_000)


def sequential_cooldown(posts: DataFrame, hours: float = SOFT_HOURS) -> DataFrame:
    """Posts that a cooldown of ``hours`` admits, symbol by symbol in time order; posts without symbol or time
    are left out. Sorted partitions stream by, and only the last admitted time of a symbol is carried on."""
    gap = micros(hours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(2).cast(pa.int64()).to_numpy()
            own = batch.column(1).dictionary_encode()
            codes, names = own.indices.to_numpy(), own.dictionary.to_pylist()
            cut = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            parts = []
            for a, b in zip(cut[:-1], cut[1:]):
                last = last if names[codes[a]] == symbol else None
                symbol = names[codes[a]]
                ok, last = admit(times[a:b], last, gap)
                parts.append(ok)
            yield batch.filter(pa.array(np.concatenate(parts)))

    rows = posts.select("id", "symbol", F.col("created_at").cast("timestamp").alias("created_at")).where("symbol is not null and created_at is not null")
    return rows.repartition("symbol").sortWithinPartitions("symbol", "created_at", "id").mapInArrow(run, rows.schema)


def recent_with_metadata(posts: DataFrame, n: int = 100) -> DataFrame:
    """The last n posts with their JSON metadata as a map."""
    return newest(posts, n).withColumn("metadata", F.from_json("metadata", "map<string,string>"))
