"""The post tables as Parquet folders by day: appends that give out ids, and updates that rewrite only the days they touch.

There is one writer at a time; readers see whole commits of Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.ordering import numbered
from signalmill.sources.landing import folder_names, landing_dir

#: Columns of each table beside its id, which comes first: fixed values. Those with ``not null`` must be given.
TABLES = {
    "posts": "created_at timestamp not null, coin_symbol string, content string not null, metadata string",
    "metrics": "post_id long, created_at timestamp not null, views long not null, traders long not null",
    "runs": "created_at timestamp not null, status string not null, summary string",
    "post_analytics": (
        "post_id long, coin_symbol string not null, created_at timestamp not null, catalyst_type string, narrative string, hook_style string, trade_setup_style string, decision_reason string, "
        "word_count int, hashtags string, gemini_decision string, square_post_link string, views long, likes long, comments long, shares long, eligible_traders long, reward_earned double, "
        "metrics_updated_at timestamp, is_analyzed int"
    ),
}
#: What an update of post_analytics may set.
MEASURES = ("views", "likes", "comments", "shares", "eligible_traders", "reward_earned")


def schema(spark: SparkSession, table: str):
    return spark.createDataFrame([], f"id long, {TABLES[table]}").schema


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's rows with their day; none where nothing has been written."""
    fields = schema(spark, table)
    if not folder_names(spark, path):
        return spark.createDataFrame([], fields).withColumn("day", F.to_date("created_at"))
    return spark.read.schema(fields.add("day", "date")).parquet(path)


def append(rows: DataFrame, path: str, table: str, order: tuple[str, ...] = ()) -> tuple[int, int]:
    """Append rows (the table's columns without id, by name; columns that aren't there are null, others are left out), with
    dense ids that go on from the largest one. The first and the last id given; the last is before the first where
    there were no rows.

    Ids come from the tasks' counts and their offsets, with no global sort; with ``order`` they follow it, by ranges of it.
    A null in a column that must be given fails the write, which then adds nothing. ``is_analyzed`` is 0 if it isn't given.
    """
    spark = rows.sparkSession
    fields = [f for f in schema(spark, table) if f.name != "id"]
    given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in fields}
    if "is_analyzed" in given:
        given["is_analyzed"] = F.coalesce(given["is_analyzed"], F.lit(0))
    sure = lambda f, c: c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"{table}.{f.name} must be given")).cast(f.dataType))
    shaped = rows.select(*[sure(f, given[f.name].cast(f.dataType)).alias(f.name) for f in fields])
    last = read(spark, path, table).agg(F.max("id")).first()[0] or 0
    kept, n = numbered(shaped, [F.col(c) for c in order], "id", last)
    kept.select("id", *[f.name for f in fields], F.to_date("created_at").alias("day")).write.mode("append").partitionBy("day").parquet(path)
    return last + 1, last + n


def update_measures(spark: SparkSession, path: str, updates: DataFrame, at) -> int:
    """Put updates (coin_symbol, any of ``MEASURES``; null: unchanged) into the newest row of each symbol whose views aren't known,
    and ``at`` into its metrics_updated_at. How many rows changed.

    Symbols of updates are upper-cased; of several updates for one symbol the first known value of each measure counts, in the
    order of the values. Only the days with such rows are rewritten: they are written beside the table first, and then
    replace their partitions by dynamic overwrite, so the table is never read while it is written, and a run
    that broke off can be repeated. Finding the rows reads four narrow columns.
    """
    rows = read(spark, path, "post_analytics")
    pending = rows.where("views is null").groupBy(F.col("coin_symbol")).agg(F.max_by(F.struct("id", "day"), F.struct("created_at", "id")).alias("target"))
    given = [m for m in MEASURES if m in updates.columns]
    new = updates.groupBy(F.upper("coin_symbol").alias("coin_symbol")).agg(*[F.min(m).alias(f"new_{m}") for m in given])
    change = pending.join(new, "coin_symbol").select(F.col("target.id").alias("id"), F.col("target.day").alias("day"), *[f"new_{m}" for m in given])
    base = landing_dir(spark)
    change.write.parquet(f"{base}/change")
    change = spark.read.schema(change.schema).parquet(f"{base}/change")
    days = [r.day for r in change.select("day").distinct().collect()]  # days of the calendar
    if not days:
        return 0
    hit = F.col("hit").isNotNull()
    merged = rows.where(F.col("day").isin(days)).join(change.drop("day").withColumn("hit", F.lit(True)), "id", "left").withColumns(
        {m: F.coalesce(f"new_{m}", m) for m in given} | {"metrics_updated_at": F.when(hit, at).otherwise(F.col("metrics_updated_at"))}
    )
    merged.select(*rows.columns).write.partitionBy("day").parquet(f"{base}/days")
    staged = spark.read.schema(rows.schema).parquet(f"{base}/days")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return change.count()


def newest(spark: SparkSession, path: str, table: str, n: int, fewest_days: int = 1) -> DataFrame:
    """The last ``n`` rows by (created_at, id), from the newest days alone: the days are known from the folder's listing, and as
    many of them are read, twice as many each time, as it takes to have n rows."""
    days = sorted((x.partition("=")[2] for x in folder_names(spark, path) if x.startswith("day=")), reverse=True)
    rows, take = read(spark, path, table), fewest_days
    while True:
        some = spark.read.schema(rows.schema).option("basePath", path).parquet(*[f"{path}/day={d}" for d in days[:take]]) if days else rows
        if take >= len(days) or some.limit(n).count() >= n:
            return some.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
        take *= 2
