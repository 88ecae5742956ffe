import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.operators.history import EXCEPTIONAL
from signalmill.streaming import posts as streams
from signalmill.streaming import scans

START = datetime(2024, 3, 1, 20)
ASSETS = "scan long, feed string, symbol string, price double, market_cap double, change_24h double, liquidity double, risk_level int, volume_ratio double, catalyst string, listed boolean, score double, decision string"


def micros(t):
    return int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def asset(t, feed, symbol, score, catalyst="news", change=6.0):
    return (micros(t), feed, symbol, 1.0, 1e7, change, 1e5, 1, 1.0, catalyst, True, score, "direct" if score >= 75 else "review" if score >= 60 else "reject")


def frame(spark, rows):
    return spark.createDataFrame(rows, ASSETS)


def notify(spark, times, path):
    rows = [(str(t) if t else None,) for t in times]
    spark.createDataFrame(rows, "at string").select(F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(path)


def run(spark, df, tmp, cap=8, files=1, broken=None):
    def assets_of(session, scan):
        if broken is not None and scan == micros(broken):
            raise RuntimeError("lost")
        return df.where(F.col("scan") == scan).drop("scan")

    notices = streams.landed(spark, str(tmp / "notices"), scans.NOTICE, files_per_batch=files)
    return scans.run_scans(notices, assets_of, str(tmp / "posted"), str(tmp / "check"), cap)


def posted(spark, tmp):
    return sorted((r.scan, r.feed, r.symbol) for r in scans.read_posted(spark, str(tmp / "posted")).where("batch >= 0").collect())


def by_hand(rows, times, cap):
    """One scan after the other over plain lists."""
    done = defaultdict(list)  # feed -> [(time, symbol)]
    for t in times:
        for feed in sorted({r[1] for r in rows if r[0] == micros(t) and r[1] is not None}):
            if sum(when.date() == t.date() for when, _ in done[feed]) >= cap:
                continue
            fine = {}
            for r in rows:
                if r[0] == micros(t) and r[1] == feed and r[2] is not None:
                    ages = [(t - when).total_seconds() / 3600 for when, s in done[feed] if s == r[2]]
                    age = min(ages, default=None)
                    held = age is not None and r[9] not in EXCEPTIONAL and (age < 24 or (age < 48 and abs(r[5]) < 5))
                    if not held:
                        fine[r[2]] = (r[12], -r[11], r[2], age)
            direct = sorted(x for x in fine.values() if x[0] == "direct")
            review = [x for x in sorted((x for x in fine.values() if x[0] == "review"), key=lambda x: x[:3])[:5] if x[3] is None or x[3] >= 24]
            for x in (direct or review)[:1]:
                done[feed].append((t, x[2]))
    return sorted((micros(t), feed, s) for feed, all_ in done.items() for t, s in all_)


@pytest.fixture(scope="module")
def market():
    rng = random.Random(3)
    times = [START + timedelta(hours=7 * k // 2) for k in range(12)]
    rows = []
    for t in times:
        for feed in ("a", "b"):
            for s in range(7):
                rows.append(asset(t, feed, f"S{s}", float(rng.randrange(50, 80)), rng.choice(["news", "news", "airdrop"]), rng.choice([4.0, 9.0])))
    rows += [asset(times[0], None, "S1", 99.0), asset(times[0], "a", None, 99.0), rows[0], rows[5]]  # nulls and repeated rows
    return rows, times


@pytest.mark.parametrize("cap, files", [(8, 1), (2, 12)])
def test_equals_one_after_the_other(spark, tmp_path, market, cap, files):
    rows, times = market
    for part in (times[:5], [times[5], times[5], None], times[6:]):
        notify(spark, part, str(tmp_path / "notices"))
    assert run(spark, frame(spark, rows), tmp_path, cap, files).awaitTermination(300)
    got, want = posted(spark, tmp_path), by_hand(rows, times, cap)
    assert got == want
    assert len(got) < 24 and (cap == 8 or by_hand(rows, times, 8) != want)


def test_a_broken_batch_is_repeated_and_posts_nothing_twice(spark, tmp_path, market):
    rows, times = market
    times, df = times[:5], frame(spark, rows)
    notify(spark, times[:1], str(tmp_path / "notices"))
    assert run(spark, df, tmp_path).awaitTermination(100)
    notify(spark, times[1:], str(tmp_path / "notices"))
    with pytest.raises(Exception):
        run(spark, df, tmp_path, broken=times[3]).awaitTermination(100)
    assert len({s for s, *_ in posted(spark, tmp_path)}) > 1  # scans before the broken one have written
    assert run(spark, df, tmp_path).awaitTermination(100)
    assert posted(spark, tmp_path) == by_hand(rows, times, 8)
    assert run(spark, df, tmp_path).awaitTermination(100)  # nothing new
    assert posted(spark, tmp_path) == by_hand(rows, times, 8)


def test_posts_before_the_stream_and_late_scans(spark, tmp_path):
    t = START
    early = spark.createDataFrame([("a", "OLD", str(t - timedelta(hours=3)), 1.0, "news")], "feed string, symbol string, created_at string, score double, catalyst string")
    scans.begin(early.withColumn("created_at", F.col("created_at").cast("timestamp")), str(tmp_path / "posted"))
    late = t - timedelta(hours=1)
    df = frame(spark, [asset(t, "a", "OLD", 90.0), asset(t, "a", "NEW", 80.0), asset(late, "a", "NEW", 90.0), asset(late, "a", "LAST", 61.0)])
    for at in (t, late):
        notify(spark, [at], str(tmp_path / "notices"))
        assert run(spark, df, tmp_path).awaitTermination(100)
    assert [x[2] for x in posted(spark, tmp_path)] == ["LAST", "NEW"]


def test_only_near_days_are_listed(spark, tmp_path):
    days = spark.range(60).select(F.lit("a").alias("feed"), F.lit("S").alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("created_at"), F.lit(1.0).alias("score"), F.lit("news").alias("catalyst"))
    scans.begin(days, str(tmp_path / "posted"))
    rows = scans.read_posted(spark, str(tmp_path / "posted"), "2024-01-10")
    assert {f.split("day=")[1][:10] for f in rows.inputFiles()} == {"2024-01-10", "2024-01-11", "2024-01-12"}


def test_nothing_to_do(spark, tmp_path):
    notify(spark, [START], str(tmp_path / "notices"))
    assert run(spark, frame(spark, []), tmp_path).awaitTermination(100)
    assert posted(spark, tmp_path) == []


def test_records_of_scans(spark, tmp_path):
    """Each scan's outcomes by feed; a batch that is repeated replaces its record, repeated rows count."""
    later = START + timedelta(hours=2)
    rows = [asset(START, "a", "X", 90.0), asset(START, "a", "Y", 80.0), asset(START, "a", "Y", 80.0), asset(START, "b", "X", 50.0), asset(START, None, "X", 90.0)]
    rows += [asset(later, "a", "X", 90.0), asset(later, "b", "X", 90.0), (*asset(later, "b", "Z", 90.0)[:3], 0.0, *asset(later, "b", "Z", 90.0)[4:])]
    notify(spark, [START, later], str(tmp_path / "notices"))
    runs, df, log = str(tmp_path / "runs"), frame(spark, rows), []
    assert scans.read_runs(spark, runs).count() == 0
    for _ in range(2):
        notices = streams.landed(spark, str(tmp_path / "notices"), scans.NOTICE)
        scans.run_scans(notices, lambda session, scan: df.where(F.col("scan") == scan).drop("scan"), str(tmp_path / "posted"), str(tmp_path / "check"), cap=1, runs=runs).awaitTermination(100)
        log.append(sorted((r.scan, r.feed, r.outcome, r.n) for r in scans.read_runs(spark, runs).collect()))
        for name in ("0", ".0.crc"):  # as after a crash before the commit
            (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    assert log[0] == log[1] == [(micros(START), "a", "passed", 3), (micros(START), "b", "passed", 1), (micros(later), "a", scans.CAPPED, 1), (micros(later), "b", "passed", 1), (micros(later), "b", "price too low", 1)]


@pytest.mark.parametrize("step, want", [(scans.decide, [("b", "Y")]), (scans.funnel, [("a", scans.CAPPED, 41), ("b", "passed", 1), ("b", "price too low", 2)])])
def test_no_feed_comes_to_one_task(spark, step, want):
    """A feed with most of a scan's assets, and its cap used up: only what has been cut or counted is shuffled by feed."""
    rows = [asset(START, "a", f"S{i}", 90.0) for i in range(40)] + [(*asset(START, f, "X", 99.0)[:3], 0.0, *asset(START, f, "X", 99.0)[4:]) for f in "abb"] + [asset(START, "b", "Y", 61.0)]
    past = spark.createDataFrame([("a", "OLD", START, 1.0, "news", START.date(), -1, 0)] * 2 + [("b", "OLD", START, 1.0, "news", START.date(), -1, 0)], scans.POSTED)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = step(frame(spark, rows), past, F.lit(START), 2)
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        got = df.select("feed", *(["outcome", "n"] if "n" in df.columns else ["symbol"])).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r) for r in got) == want
    depth, found = [len(re.match(r"[ :+*|-]*", line)[0].replace("*", "").rstrip()) for line in plan], 0
    for i, line in enumerate(plan):
        if re.search(r"Exchange hashpartitioning\(feed#\d+, \d+\)", line):
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert re.search("Aggregate|WindowGroupLimit", "\n".join(plan[i:below])), "\n".join(plan)
            found += 1
    assert found
