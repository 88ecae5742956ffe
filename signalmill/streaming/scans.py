"""Scans as a stream: each scan judges its assets by the posts that the scans before it have made, and adds its own.

A scan's assets are landed first, as any table that can be read by scan. Then its notice lands: one row that says when
the scan was made. A stream of notices drives the work, so a scan of any size belongs to one batch and is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from signalmill.functions.numbers import hours_between
from signalmill.operators import filters, routing
from signalmill.operators.history import DAILY_CAP, WEAK_HOURS
from signalmill.sources.landing import folder_names

#: The table of posts: ``scan`` is the scan's time in microseconds, ``batch`` the one that handled it; posts from before the stream have batch -1.
POSTED = "feed string, symbol string, created_at timestamp, score double, catalyst string, day date, batch long, scan long"
#: A notice of a scan.
NOTICE = "at timestamp"
#: The records of scans.
RUNS = "feed string, outcome string, n long, batch long, scan long"
CAPPED = "daily cap"


def _write(posts: DataFrame, path: str, batch: int, scan: int) -> None:
    """Posts by day, batch and scan. Writing a scan again replaces what it has written before."""
    rows = posts.select("feed", "symbol", "created_at", "score", "catalyst", F.to_date("created_at").alias("day"), F.lit(batch).cast("long").alias("batch"), F.lit(scan).cast("long").alias("scan"))
    rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch", "scan").parquet(path)


def begin(posts: DataFrame, path: str) -> None:
    """Posts (feed, symbol, created_at, score, catalyst) from before the first scan."""
    _write(posts, path, -1, 0)


def read_posted(spark: SparkSession, path: str, since: str = "") -> DataFrame:
    """Posts of the day ``since`` (like 2024-01-31) and later days; only their folders are listed."""
    days = [n for n in folder_names(spark, path) if n.startswith("day=") and n[4:] >= since]
    if not days:
        return spark.createDataFrame([], POSTED)
    return spark.read.schema(POSTED).option("basePath", path).parquet(*[f"{path}/{d}" for d in days])


def read_runs(spark: SparkSession, runs: str) -> DataFrame:
    """The records that ``run_scans`` has written. A scan that was noticed again in a later batch has a record of each."""
    if not folder_names(spark, runs):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).option("basePath", runs).parquet(runs)


def judged(assets: DataFrame, past: DataFrame, at: Column, top: tuple = filters.TOP_FIVE) -> DataFrame:
    """A scan's assets with ``outcome``: the rule that holds them back, or "passed". The cap of a feed is no rule of an asset; ``full_feeds`` has it.

    ``assets``: feed and the columns of ``filters.reject_reason`` but hours_ago, with score and decision (direct, review,
    reject). Rows without feed or symbol are left out. Posts later than ``at``, of a scan that lands late, hold a symbol as
    if they were made just then.
    """
    ages = past.groupBy("feed", "symbol").agg(F.max("created_at").alias("newest"))
    ages = ages.select("feed", "symbol", F.greatest(F.lit(0.0), hours_between(F.col("newest"), at)).alias("hours_ago"))
    known = assets.withColumn("feed", F.col("feed").cast("string")).where("feed is not null and symbol is not null")
    return known.join(ages, ["feed", "symbol"], "left").withColumn("outcome", F.coalesce(filters.reject_reason(top=top), F.lit("passed")))


def full_feeds(past: DataFrame, at: Column, cap: int = DAILY_CAP) -> DataFrame:
    """(feed, full) of the feeds whose cap of the day is used up. Joined with a row or a few of each feed, never with a scan's
    assets, which would bring a feed to one task."""
    return past.where(F.col("day") == F.to_date(at)).groupBy("feed").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("feed", F.lit(True).alias("full"))


def decide(assets: DataFrame, past: DataFrame, at: Column, cap: int = DAILY_CAP, top: tuple = filters.TOP_FIVE) -> DataFrame:
    """What each feed posts at a time: nothing if the day's cap is used up, else of the assets that no rule rejects the
    best direct one, or the best one for review that no cooldown holds.

    A symbol that comes twice counts as one, equal scores go by symbol. A feed's assets are cut to a pool of a few before
    they are shuffled by feed, so that one feed may have most of the rows. The cap then drops whole feeds (by an outer join:
    Spark would push an anti join back to the assets).
    """
    best = routing.route(judged(assets, past, at, top).where("outcome = 'passed'"), "feed").where("rank = 1")
    free = best.join(full_feeds(past, at, cap), "feed", "left").where("full is null")
    return free.select("feed", "symbol", at.alias("created_at"), "score", "catalyst")


def funnel(assets: DataFrame, past: DataFrame, at: Column, cap: int = DAILY_CAP, top: tuple = filters.TOP_FIVE) -> DataFrame:
    """A scan's record: how many assets of each feed came to which outcome, a used-up cap before all others. Rows are counted as they come, repeated ones too.
    It reads the assets again: counts observed before a shuffle would count a task twice that is run again for a lost executor."""
    counts = judged(assets, past, at, top).groupBy("feed", "outcome").agg(F.count("*").alias("n"))
    outcome = F.when(F.col("full"), CAPPED).otherwise(F.col("outcome")).alias("outcome")
    return counts.join(full_feeds(past, at, cap), "feed", "left").groupBy("feed", outcome).agg(F.sum("n").alias("n"))


def run_scans(
    notices: DataFrame, assets_of: Callable[[SparkSession, int], DataFrame], path: str, checkpoint: str, cap: int = DAILY_CAP, top: tuple = filters.TOP_FIVE, trigger: dict | None = None,
    runs: str | None = None,
) -> StreamingQuery:
    """Handle each scan that a stream of notices names, and keep the table of posts below ``path``; ``read_posted`` reads it.

    ``assets_of`` gives a scan's assets by its time in microseconds. Scans of a batch are handled one after the other by time,
    as each hangs on the posts before it; the feeds of a scan are handled at once. A scan sees the posts of earlier
    batches and of its batch's earlier scans alone, so a batch that is repeated after a crash decides the same and replaces
    what it had written: nothing is posted twice. Notices without a time are left out, repeated ones of a batch count
    once. Only the days that a cooldown can reach back to are read. With ``runs`` each scan's ``funnel`` is written below
    that folder, replaced likewise when a batch is repeated; ``read_runs`` reads it.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for r in batch.where("at is not null").select(F.unix_micros("at").alias("scan")).distinct().orderBy("scan").collect():  # a batch's notices
            at = F.timestamp_micros(F.lit(r.scan))
            reach = datetime.fromtimestamp(r.scan // 1_000_000, timezone.utc) - timedelta(hours=WEAK_HOURS + 24)  # a day more, for sessions of any time zone
            before = (F.col("batch") < number) | ((F.col("batch") == number) & (F.col("scan") < r.scan))
            past = read_posted(spark, path, f"{reach:%Y-%m-%d}").where(before)
            if runs:
                funnel(assets_of(spark, r.scan), past, at, cap, top).write.mode("overwrite").parquet(f"{runs}/batch={number}/scan={r.scan}")
            _write(decide(assets_of(spark, r.scan), past, at, cap, top), path, number, r.scan)

    return notices.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
