import random
import time

import pytest
from pyspark.sql import functions as F

from signalmill.functions import text
from signalmill.operators import history
from signalmill.streaming import posts as streams

SCHEMA = "id long, symbol string, created_at timestamp, content string"


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    df = spark.range(400).select(
        "id", F.concat(F.lit("S"), F.col("id") % 7).alias("symbol"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 3).cast("int"))).alias("created_at"),
        F.concat(F.lit("post "), F.col("id") % 50).alias("content"),
    )
    path = str(tmp_path_factory.mktemp("posts"))
    for k in range(4):  # files in time order, so that batches are too
        df.where((F.col("id") >= 100 * k) & (F.col("id") < 100 * k + 100)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def collected(spark, rows, tmp_path):
    q = streams.run_to_table(rows, str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(300)
    return {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def land(spark, rows, path):
    """One more file; rows are (id, symbol, time)."""
    spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "id long, symbol string, created_at string, content string").withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


HEARTBEAT = (None, None, "2030-01-01")


@pytest.fixture(scope="module")
def scattered(spark):
    """Posts of few symbols at all distances, in files that overlap in time; nulls, and ties in time."""
    rng = random.Random(8)
    rows = [(i, f"S{rng.randrange(3)}", f"2024-01-{1 + i // 30:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}.{rng.randrange(10**6):06d}") for i in range(300)]
    rows += [(1000 + i, "S1", rows[i][2]) for i in range(20)] + [(2000, None, "2024-01-03"), (2001, "S2", None), (2002, "S0", "2024-01-01 00:00:00")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, symbol string, at string").select("id", "symbol", F.col("at").cast("timestamp").alias("created_at"))


@pytest.mark.parametrize("rule", ["cooldown", "daily_cap"])
@pytest.mark.parametrize("cuts", [[0, 325], [0, 100, 101, 200, 325]])
def test_equals_batch_for_any_files_and_pauses(spark, scattered, tmp_path, rule, cuts):
    """Each file is a run of its own that stops and starts again from the checkpoint."""
    rows, df = scattered
    path, got = str(tmp_path / "in"), set()
    stream, batch = {"cooldown": (streams.cooldown, history.sequential_cooldown), "daily_cap": (streams.daily_cap, history.within_cap)}[rule]
    limit = 24 if rule == "cooldown" else 5
    for a, b in zip(cuts[:-1], cuts[1:]):
        land(spark, rows[a:b], path)
        got = collected(spark, stream(streams.landed(spark, path, SCHEMA), limit, "9999 hours"), tmp_path)
    land(spark, [HEARTBEAT], path)
    got = collected(spark, stream(streams.landed(spark, path, SCHEMA), limit, "9999 hours"), tmp_path)
    assert got == {r.id for r in batch(df.where("created_at is not null"), limit).collect()}
    assert 0 < len(got) < 300
    everything = spark.read.parquet(str(tmp_path / "out"))
    assert everything.count() == len(got)


def test_cooldown_goes_by_the_posts_time(spark, tmp_path):
    """Two posts two seconds apart under a cooldown of four, in runs that are further apart than that."""
    path, hours = str(tmp_path / "in"), 4 / 3600
    for rows in ([(1, "A", "2024-01-01 00:00:00")], [(2, "A", "2024-01-01 00:00:02")], [(3, "A", "2024-01-01 00:00:04"), HEARTBEAT]):
        land(spark, rows, path)
        got = collected(spark, streams.cooldown(streams.landed(spark, path, SCHEMA), hours, "10 seconds"), tmp_path)
        time.sleep(1)
    assert got == {1, 3}


def test_late_post_within_the_delay_takes_its_place(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(2, "A", "2024-01-01 10:00:00")], [(1, "A", "2024-01-01 09:00:00")], [HEARTBEAT]):
        land(spark, rows, path)
        got = collected(spark, streams.cooldown(streams.landed(spark, path, SCHEMA), 4, "2 hours"), tmp_path)
    assert got == {1}


def state_rows(spark, tmp_path, name):
    """Of the last batch: what the store holds in a state variable."""
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "check")).count()


@pytest.mark.parametrize("rule, held", [("cooldown", "last"), ("daily_cap", "sent")])
def test_state_ends(spark, tmp_path, rule, held):
    """State is there while it can matter and gone when the watermark has passed its end; a day never counts anew."""
    path, counts = str(tmp_path / "in"), []
    make = {"cooldown": lambda r: streams.cooldown(r, 24, "1 second"), "daily_cap": lambda r: streams.daily_cap(r, 2, "1 second")}[rule]
    ten = [(i, f"S{i}", f"2024-01-01 00:00:{i:02d}") for i in range(10)]
    for rows in (ten, [(None, None, "2024-01-01 12:00:00")], [(None, None, "2024-01-02 12:00:00")], [(50, "S1", "2024-01-01 13:00:00"), (51, "S1", "2024-01-02 12:00:01")], [HEARTBEAT]):
        land(spark, rows, path)
        got = collected(spark, make(streams.landed(spark, path, SCHEMA)), tmp_path)
        counts.append(state_rows(spark, tmp_path, held))
    assert counts[1] == (10 if rule == "cooldown" else 1) and counts[2] == 0 and counts[4] == 0
    assert got == ({*range(10), 51} if rule == "cooldown" else {0, 1, 51})


def test_cooldown_packs_what_waits(spark, tmp_path):
    """A batch adds its posts to a key's state as one value, so that calls to the state don't grow with the posts."""
    path = str(tmp_path / "in")
    for k in range(2):
        land(spark, [(1000 * k + i, f"S{i % 3}", f"2024-01-01 00:{i % 60:02d}:{k:02d}") for i in range(900)], path)
        collected(spark, streams.cooldown(streams.landed(spark, path, SCHEMA), 24, "9999 hours"), tmp_path)
        assert 0 < state_rows(spark, tmp_path, "waiting") <= 3 * (k + 1)


@pytest.mark.parametrize("buckets", [1, 5])
def test_symbols_that_share_a_key_are_apart(spark, tmp_path, buckets):
    """Many symbols to a key, ids beyond those of doubles, rows without an id among them, and a watermark that cuts a key's posts."""
    rng, path = random.Random(3), str(tmp_path / "in")
    rows = [(2**53 + 1 + i, f"S{rng.randrange(40)}", f"2024-01-{1 + i // 100:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00.000001") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, symbol string, at string").select("id", "symbol", F.col("at").cast("timestamp").alias("created_at"))
    for k in range(0, 1000, 250):
        part = rows[k : k + 250] + [(None, None, rows[k][2]), (None, "S1", rows[k][2])]
        rng.shuffle(part)
        land(spark, part, path)
        collected(spark, streams.cooldown(streams.landed(spark, path, SCHEMA), 30, "25 hours", buckets), tmp_path)
    land(spark, [HEARTBEAT], path)
    got = collected(spark, streams.cooldown(streams.landed(spark, path, SCHEMA), 30, "25 hours", buckets), tmp_path)
    assert got == {r.id for r in history.sequential_cooldown(df, 30).collect()}
    assert [state_rows(spark, tmp_path, name) for name in ("waiting", "last", "timer")] == [0, 0, 0]


def test_tasks_send_a_days_first_posts_only(spark):
    rows = spark.range(100_000).select(F.lit(3).cast("long").alias("day"), "id", F.lit("S").alias("symbol"), (F.lit(200_000) - F.col("id")).alias("at")).repartition(4)
    out = streams.first_of_days(rows, 8).collect()
    assert len(out) <= 32 and {99_999 - i for i in range(8)} <= {r.id for r in out}


def test_first_signatures(spark, posts, tmp_path):
    df, path = posts
    rows = streams.landed(spark, path, SCHEMA).withColumn("signature", text.signature("content"))
    assert len(collected(spark, streams.first_signatures(rows, "9999 hours"), tmp_path)) == 50


def test_signatures_come_again_after_the_watermark(spark, tmp_path):
    """A copy within the delay goes, one that comes when the first has been forgotten stays."""
    path = str(tmp_path / "in")
    for rows in ([(1, "A", "2024-01-01 00:00:00"), (2, "B", "2024-01-01 00:30:00")], [(3, "A", "2024-01-01 01:00:00")], [(None, None, "2024-01-03")], [(4, "A", "2024-01-03 00:00:01")]):
        land(spark, rows, path)
        stream = streams.landed(spark, path, SCHEMA).withColumn("signature", F.when(F.col("id").isNotNull(), text.signature("content")).otherwise("beat"))
        got = collected(spark, streams.first_signatures(stream, "2 hours"), tmp_path)
    assert got - {None} in ({1, 4}, {2, 4})


@pytest.mark.parametrize("merge_every", [50, 2, 1])
def test_keep_latest(spark, posts, tmp_path, merge_every):
    df, path = posts
    rows = streams.landed(spark, path, SCHEMA, files_per_batch=1).withColumnRenamed("created_at", "ts")
    streams.keep_latest(rows, str(tmp_path / "latest"), str(tmp_path / "check"), merge_every=merge_every).awaitTermination(180)
    last = streams.read_latest(spark, str(tmp_path / "latest"))
    assert {(r.symbol, r.id) for r in last.collect()} == {(r.symbol, r.id) for r in df.groupBy("symbol").agg(F.max("id").alias("id")).collect()}
    names = {p.name for p in (tmp_path / "latest").iterdir()}
    assert ("merged=3" in names) == (merge_every < 50) and ("batch=0" in names) == (merge_every == 50)
