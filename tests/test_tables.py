import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signalmill.operators import filters, history, ordering, reports, topics
from signalmill.sources import feeds, tables
from signalmill.streaming import posts as streams


def row(i, symbol, day, views=None, **more):
    return {"post_id": i, "coin_symbol": symbol, "created_at": f"2024-01-{day:02d} 12:00:00", "views": views, "likes": i} | more


def frame(spark, rows):
    schema = "post_id long, coin_symbol string, created_at string, views long, likes long"
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("created_at", F.col("created_at").cast("timestamp"))


def files(path):
    return {d: {f for f in os.listdir(f"{path}/{d}") if f.startswith("part")} for d in os.listdir(path) if d.startswith("day=")}


@pytest.mark.parametrize("order", [(), ("created_at", "post_id")])
def test_ids_go_on_and_are_dense(spark, tmp_path, order):
    path, got = str(tmp_path / "t"), []
    for k in range(3):
        rows = frame(spark, [row(100 * k + i, "A", 1 + (i * 7) % 9) for i in range(40)]).repartition(6)
        got.append(tables.append(rows, path, "post_analytics", order))
    assert got == [(1, 40), (41, 80), (81, 120)]
    kept = tables.read(spark, path, "post_analytics").collect()
    assert sorted(r.id for r in kept) == list(range(1, 121))
    assert all((r.id - 1) // 40 == r.post_id // 100 and r.is_analyzed == 0 for r in kept)
    if order:
        first = sorted((r for r in kept if r.id <= 40), key=lambda r: r.id)
        assert first == sorted(first, key=lambda r: (r.created_at, r.post_id))


def test_append_of_nothing_and_of_too_little(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.append(frame(spark, []), path, "post_analytics") == (1, 0)
    assert tables.read(spark, path, "post_analytics").count() == 0
    with pytest.raises(Exception, match="must be given"):
        tables.append(frame(spark, [row(1, None, 1), row(2, "A", 1)]), path, "post_analytics")
    assert tables.read(spark, path, "post_analytics").count() == 0
    assert tables.append(frame(spark, [row(2, "A", 1)]).withColumn("extra", F.lit(1)), path, "post_analytics") == (1, 1)


def test_every_table_takes_rows(spark, tmp_path):
    for name in tables.TABLES:
        rows = spark.createDataFrame([("2024-01-01", "A", "text", 1, 2, "done")], "at string, coin_symbol string, content string, views long, traders long, status string").withColumn("created_at", F.col("at").cast("timestamp"))
        assert tables.append(rows, str(tmp_path / name), name) == (1, 1)
        assert tables.read(spark, str(tmp_path / name), name).columns[0] == "id"


def test_update_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [row(i, "ABC"[i % 3], 1 + i % 5, None if i < 12 else 7) for i in range(15)]
    tables.append(frame(spark, rows).coalesce(1), path, "post_analytics", ("post_id",))
    before, had = files(path), {r.post_id: r for r in tables.read(spark, path, "post_analytics").collect()}
    updates = spark.createDataFrame([("a", 50, None), ("zz", 1, 1), ("B", None, 9)], "coin_symbol string, views long, shares long")
    assert tables.update_measures(spark, path, updates, F.lit("2024-02-01").cast("timestamp")) == 2
    now, have = files(path), {r.post_id: r for r in tables.read(spark, path, "post_analytics").collect()}
    # The newest pending rows: of A 9 (day 5), of B 4 (day 5).
    assert {i for i in have if have[i] != had[i]} == {9, 4}
    assert (have[9].views, have[9].shares, have[4].views, have[4].shares, have[9].likes) == (50, None, None, 9, 9)
    assert str(have[9].metrics_updated_at) == "2024-02-01 00:00:00" and have[5].metrics_updated_at is None
    assert {d for d in now if now[d] != before[d]} == {"day=2024-01-05"} and set(now) == set(before)
    # Again: 9 has its views now, so the next one is taken.
    assert tables.update_measures(spark, path, updates.where("coin_symbol = 'a'"), F.lit("2024-02-02").cast("timestamp")) == 1
    assert {r.post_id: r for r in tables.read(spark, path, "post_analytics").collect()}[3].views == 50


def test_update_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(frame(spark, [row(1, "A", 1, 5)]), path, "post_analytics")
    before = files(path)
    assert tables.update_measures(spark, path, spark.createDataFrame([("A", 1)], "coin_symbol string, views long"), F.current_timestamp()) == 0
    assert files(path) == before


def test_newest_opens_the_last_days_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select(F.lit("A").alias("coin_symbol"), F.col("id").alias("post_id"), (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("created_at"))
    tables.append(rows.coalesce(1), path, "post_analytics", ("created_at",))
    got = tables.newest(spark, path, "post_analytics", 10)
    assert [r.post_id for r in got.collect()] == list(range(999, 989, -1))
    assert len(got.inputFiles()) <= 16
    assert tables.newest(spark, path, "post_analytics", 5000).count() == 1000
    assert tables.newest(spark, str(tmp_path / "none"), "post_analytics", 3).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered(spark, parts):
    rows = spark.range(500).select((F.col("id") * 7 % 50).alias("k"), "id").repartition(parts)
    out, n = ordering.numbered(rows, [F.desc("k"), F.asc("id")], "place", 10)
    want = sorted(((r.k, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert n == 500 and [(r.k, r.id) for r in out.orderBy("place").collect()] == want
    assert sorted(r.place for r in out.collect()) == list(range(11, 511))
    assert ordering.numbered(rows.limit(0), [F.asc("k")], "place")[1] == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topics_meet_in_no_single_task(spark):
    named = spark.range(300).select(F.concat(F.lit("P"), F.col("id") % 40).alias("symbol"))
    out = topics.from_announcements(named.select(F.lit("AI").alias("narrative")), named)
    assert "SinglePartition" not in plan_of(out)
    assert [r["rank"] for r in out.orderBy("rank").collect()] == list(range(1, 42))


def test_insights_scan_once(spark, tmp_path):
    rows = spark.range(200).select(
        F.concat(F.lit("c"), F.col("id") % 7).alias("catalyst_type"), F.when(F.col("id") % 3 == 0, "listing").otherwise("").alias("narrative"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("h"), F.col("id") % 5)).alias("hook_style"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 5).cast("int"))).alias("created_at"), (F.col("id") % 11).alias("views"), F.lit(4).alias("word_count"),
    )
    rows.write.parquet(str(tmp_path / "t"))
    out = reports.insights(spark.read.parquet(str(tmp_path / "t")))
    assert plan_of(out).count("Scan parquet") == 1
    got = {(r.section, r.key): (r.n, r.value) for r in out.collect()}
    assert Counter(s for s, _ in got) == {"catalyst": 5, "narrative": 1, "hook": 4, "hour": 3, "words": 1}
    assert got["words", "all"] == (200, 4.0) and got["narrative", "listing"] == (67, None) and got["hour", "0"] == (40, None)
    assert got["catalyst", "c0"][1] == pytest.approx(sum(i % 11 for i in range(0, 200, 7)) / 29)


def test_audit_and_funnel_come_with_the_writing(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"symbol": " a ", "timestamp": "2024-01-01T00:00:00+00:00"}\nno json\n{"symbol": "", "timestamp": "2024-01-01T00:00:00"}\n{"symbol": "B", "timestamp": "never"}\n')
    lines = feeds.read_history(spark, str(tmp_path / "log.jsonl"))
    assert history.write_clean(lines, str(tmp_path / "clean")) == {"n_valid": 1, "n_corrupt": 3}
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "clean")).collect()] == ["A"]
    asset = "symbol string, price double, market_cap double, change_24h double, liquidity double, risk_level int, volume_ratio double, catalyst string, hours_ago double, listed boolean"
    rows = spark.createDataFrame([("A", 1.0, 1e7, 9.0, 0.0, 1, 2.0, None, None, True), ("B", 0.0, 1e7, 9.0, 0.0, 1, 2.0, None, None, True), ("C", 1.0, 1e7, 9.0, 0.0, 1, 2.0, None, None, False)], asset)
    assert filters.write_candidates(rows, str(tmp_path / "c")) == {"passed": 1, "price too low": 1, "not listed": 1}
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["A"]


def test_history_stream_has_no_line_twice(spark, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    for k in range(3):
        (lines / f"{k}.json").write_text(f'{{"symbol": "s{k}", "timestamp": "2024-01-0{k + 1}T00:00:00+00:00", "link": "x"}}\nbroken {k}\n')
    stream = lambda: streams.landed(spark, str(lines), feeds.HISTORY, "json", files_per_batch=1)
    out = str(tmp_path / "out")
    streams.split_history(stream(), out, str(tmp_path / "check")).awaitTermination()
    kept = lambda: [sorted(r[c] for r in streams.read_history_sink(spark, out, kind).collect()) for kind, c in (("clean", "symbol"), ("quarantine", "_corrupt_record"))]
    want = [["s0", "s1", "s2"], ["broken 0", "broken 1", "broken 2"]]
    assert kept() == want
    # The last batch again, as after a crash before its commit.
    os.remove(tmp_path / "check" / "commits" / "2")
    crc = tmp_path / "check" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    streams.split_history(stream(), out, str(tmp_path / "check")).awaitTermination()
    assert kept() == want
    assert streams.read_history_sink(spark, str(tmp_path / "none"), "clean").count() == 0


def parts(path):
    return {f"{d}/{s}": {f for f in os.listdir(f"{path}/{d}/{s}") if f.startswith("part")} for d in os.listdir(path) if d.startswith("day=") for s in os.listdir(f"{path}/{d}")}


def artifacts(spark, days, n=300):
    """Rows of every day in all tasks; one status needs an escape in a folder's name, one is null."""
    return spark.range(n).repartition(6).select("id", F.explode(F.array(*[F.lit(d) for d in days])).alias("day"), F.when(F.col("id") % 3 == 0, "held: 5%+").when(F.col("id") % 3 == 1, "published").alias("status"))


def test_files_of_artifacts_follow_bytes(spark, tmp_path):
    path = str(tmp_path / "a")
    feeds.write_artifacts(artifacts(spark, ["2024-01-01", "2024-01-02"]), path)
    assert all(len(f) == 1 for f in parts(path).values()) and len(parts(path)) == 6
    feeds.write_artifacts(artifacts(spark, ["2024-01-03"], 100), path, rows_per_file=15)
    assert len(parts(path)["day=2024-01-03/status=published"]) == 3


def test_compaction_touches_only_crowded_parts(spark, tmp_path):
    path = str(tmp_path / "a")
    assert feeds.compact_artifacts(spark, path) == []
    feeds.write_artifacts(artifacts(spark, ["2024-01-01", "2024-01-02"]), path)
    assert feeds.compact_artifacts(spark, path) == []
    for _ in range(3):
        feeds.write_artifacts(artifacts(spark, ["2024-01-02"]), path)
    before, rows = parts(path), Counter(spark.read.parquet(path).collect())
    assert feeds.compact_artifacts(spark, path, small=1) == []
    assert feeds.compact_artifacts(spark, path) == [("2024-01-02", s) for s in (feeds.NO_VALUE, "held: 5%+", "published")]
    after = parts(path)
    assert Counter(spark.read.parquet(path).collect()) == rows
    assert {k for k in before if before[k] == after[k]} == {k for k in before if "2024-01-01" in k} and all(len(f) == 1 for f in after.values())
