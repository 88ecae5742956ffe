"""From scored assets to the ones that go on: direct, review, ranking lists, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators.history import SOFT_HOURS
from signalmill.operators.ordering import ranked


def route(scored: DataFrame, group: str, pool: int = 5, keep: int = 3, hours: float = SOFT_HOURS) -> DataFrame:
    """Per group the best direct asset; where there is none, of the best ``pool`` for review the first
    ``keep`` that no cooldown holds (hours_ago, null: never posted)."""
    place = F.row_number().over(Window.partitionBy(group, "decision").orderBy(F.desc("score"), "symbol"))
    ranked = scored.where("decision <> 'reject'").withColumn("place", place).where(F.col("place") <= pool)
    direct = F.col("decision") == "direct"
    ranked = ranked.withColumn("any_direct", F.max(direct).over(Window.partitionBy(group)))
    free = F.col("hours_ago").isNull() | (F.col("hours_ago") >= hours)
    ranked = ranked.where((direct & (F.col("place") == 1)) | (~F.col("any_direct") & free))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("place"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= keep).drop("place", "any_direct")


def ranking_list(scored: DataFrame, group: str, pick: Column) -> DataFrame:
    """Each group's assets with the pick first and the others by score."""
    out = ranked(scored.withColumn("picked", pick), [group], {"turn": F.when(F.col("picked"), 0).otherwise(1), "step": -F.col("score")}, ["symbol"], "rank")
    return out.withColumns({"verdict": F.when(F.col("picked"), "publish").otherwise("skip"), "reason": F.when(F.col("picked"), "selected by score").otherwise("lower score or review")})


def match_pick(picks: DataFrame, packages: DataFrame, group: str) -> DataFrame:
    """Each pick's package by symbol, case aside; the group's first package where none matches."""
    named = packages.select(group, F.upper("symbol").alias("key"), F.col("package_id").alias("matched")).groupBy(group, "key").agg(F.min("matched").alias("matched"))
    first = packages.groupBy(group).agg(F.min("package_id").alias("first_package"))
    return picks.withColumn("key", F.upper("symbol")).join(named, [group, "key"], "left").join(first, group, "left").select(group, "symbol", F.coalesce("matched", "first_package").alias("package_id"))
