"""Ranks, numbers and neighbours in an order without bringing a group together.

Rows of a group fall into buckets that follow the order. Buckets are counted by partial sums, and only within a bucket are
rows sorted; what lies before a bucket comes from the few bucket rows of its group. All rows together are numbered by
ranges with sampled bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.sources.landing import written


def ranked(rows: DataFrame, group: list[str], buckets: dict[str, Column], within: list, name: str) -> DataFrame:
    """Rank from 1 in each group by the buckets (ascending, never null), then by ``within``."""
    keys = [*group, *buckets]
    parted = rows.withColumns(buckets)
    earlier = Window.partitionBy(*group).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy(*keys).agg(F.count("*").alias("n_bucket")).withColumn("n_before", F.coalesce(F.sum("n_bucket").over(earlier), F.lit(0))).drop("n_bucket")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*within))
    return parted.join(before, keys).withColumn(name, (F.col("n_before") + own).cast("int")).drop(*buckets, "n_before")


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 0) -> tuple[DataFrame, int]:
    """All rows with dense numbers from ``start`` + 1, and how many there are.

    With an order the rows are dealt to ranges of it by sampled bounds and sorted within each; without one they stay where
    they are. They are written with their place in their partition; a number is that place plus the counts of the
    partitions before, which are one row for each task.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    # The id of a row in a partition is the partition's number times 2^33 and its place.
    placed = written(placed.withColumn("row_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("row_place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task
    shifts, total = [], 0
    for number, n in counts:
        shifts.append((number, start + 1 + total - (number << 33)))
        total += n
    offsets = spark.createDataFrame(shifts, "row_part long, row_shift long")
    out = placed.withColumn("row_part", part.cast("long")).join(F.broadcast(offsets), "row_part")
    return out.withColumn(name, F.col("row_place") + F.col("row_shift")).drop("row_part", "row_place", "row_shift"), total


def neighbour(rows: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str, after: bool = False) -> DataFrame:
    """``value`` of the row before (or after) in a key's order, null at its end. Rows fall into buckets of the
    key; the rows at their edges look at the nearest bucket that has rows."""
    parted = rows.withColumn("bucket", bucket)
    inside, over = Window.partitionBy(key, "bucket").orderBy(*order), Window.partitionBy(key).orderBy("bucket")
    edge, step = (F.min_by, F.lead) if after else (F.max_by, F.lag)
    edges = parted.groupBy(key, "bucket").agg(edge(value, F.struct(*order)).alias("edge")).withColumn("edge", step("edge").over(over))
    return parted.join(edges, [key, "bucket"]).withColumn(name, F.coalesce(step(value).over(inside), "edge")).drop("bucket", "edge")
