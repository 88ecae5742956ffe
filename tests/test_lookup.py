import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators import lookup


def pairs(found):
    return sorted((r.id, r.name) for r in found.collect())


@pytest.mark.parametrize("any_case", [False, True])
@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_equals_looking_for_each_name(spark, any_case, block_bytes):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abAB") for _ in range(n))
    names = sorted({word(rng.randrange(1, 6)) for _ in range(40)})
    texts = [(i, word(rng.randrange(0, 30))) for i in range(200)] + [(900, None), (901, ""), (902, "ab" * 20_000)]
    fold = str.lower if any_case else str
    want = sorted((i, n) for i, t in texts for n in names if t and fold(n) in fold(t))
    found = lookup.found_in(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "name string"), any_case, block_bytes)
    assert pairs(found) == want and want


def test_a_task_keeps_no_objects_of_names():
    """Memory of a block of names, as Python counts it: the letters' nodes, not strings, tuples and lists for each name."""
    import tracemalloc

    import pyarrow as pa

    n = 50_000
    held = pa.table({"key": [f"p{i}" for i in range(n)], "names": [[f"P{i}"] for i in range(n)]})
    tracemalloc.start()
    tree = lookup.automaton(held)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 150 * n
    assert {held["names"][i].as_py()[0] for _, i in tree.iter("see p123")} == {"P1", "P12", "P123"}


def test_nothing_on_either_side(spark):
    texts, names = spark.createDataFrame([(1, "x")], "id long, text string"), spark.createDataFrame([("x",)], "name string")
    assert pairs(lookup.found_in(texts.limit(0), names)) == [] and pairs(lookup.found_in(texts, names.limit(0))) == []
    assert pairs(lookup.found_in(texts.withColumn("name", F.lit("z")), names.withColumn("text", F.lit("y")))) == [(1, "x")]


def test_a_hundred_thousand_entries(spark):
    """Long names that share most of their letters."""
    dim = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("the long name of the entry with number "), F.col("id") + 100_000, F.lit(".")).alias("topic"), F.concat(F.lit("S"), "id").alias("symbol"))
    topics = spark.createDataFrame([("see the long name of the entry with number 150000.",), ("number 199999.",), ("number 1",), ("NONE",)], "topic string")
    got = {r.topic: list(r.assets) for r in lookup.assets_of_topics(topics, dim).select("topic", "assets").collect()}
    assert got == {"see the long name of the entry with number 150000.": ["S50000"], "number 199999.": ["S99999"], "number 1": ["S0"], "NONE": ["NONE"]}


def announcements(spark, n):
    """Titles that have most words in common; one common word is known, one isn't."""
    title = F.concat(F.lit("Exchange lists HOT now (S"), F.col("id") % 50, F.lit(") and S"), F.col("id") % 7)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("news", "airdrop", "new_listing", "other")]), (F.xxhash64("id") % 2 + F.col("id") % 2 + 2).cast("int"))
    known = spark.createDataFrame([("HOT",), ("S3",), ("S3",), ("S8",), ("S49",), ("unseen",), (None,)], "symbol string")
    return spark.range(n).select(F.col("id").alias("ann_id"), kind.alias("ann_type"), title.alias("title")), known


@pytest.mark.parametrize("frequent", [1 << 16, 100])
def test_common_words_of_titles_stay_out_of_one_task(spark, frequent):
    ann, known = announcements(spark, 4000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = lookup.mentions(ann, known, frequent).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for i in range(4000):
        words = [f"S{i % 50}", *dict.fromkeys(w for w in ("Exchange", "lists", "HOT", "now", "and", f"S{i % 7}") if w != f"S{i % 50}")]
        want += [(i, w) for w in words if w in ("HOT", "S3", "S8", "S49")]
    assert sorted((r.ann_id, r.symbol) for r in found) == sorted(want)
    assert len({r.task for r in found if r.symbol == "HOT"}) == (4 if frequent == 100 else 1)


def test_first_mentions_hold_what_the_first_and_the_strongest_need(spark):
    ann, known = announcements(spark, 300)
    few, every = lookup.first_mentions(ann, known), lookup.mentions(ann, known)
    assert few.count() < every.count() / 10
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assets = known.where("symbol is not null").distinct()
    best = {s: min(((-lookup.PRIORITIES.get(r.ann_type, 0), r.ann_id) for r in every.collect() if r.symbol == s), default=None) for s in ("HOT", "S3", "S8", "S49")}
    assert rows(lookup.strongest_catalyst(few).select("symbol", "ann_id", "priority")) == sorted((s, i, -p) for s, (p, i) in best.items())
    assert rows(lookup.first_announcement(assets, few)) == rows(lookup.first_announcement(assets, every))
    assert {r.symbol: r.ann_id for r in lookup.first_announcement(assets, every).collect()} == {s: min((r.ann_id for r in every.collect() if r.symbol == s), default=None) for s in ("HOT", "S3", "S8", "S49", "unseen")}


def test_joins_of_titles_get_no_row_per_title(spark):
    """What titles have in common is brought together in the tasks that read them, by hashing."""
    ann, known = announcements(spark, 300)
    plan = lookup.first_mentions(ann, known)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.index("Join") < plan.index("HashAggregate") < plan.index("Generate")
