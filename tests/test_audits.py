import os

import pytest

from signalmill.sources import feeds
from signalmill.streaming import audits
from signalmill.streaming import posts as streams


def land(path, k, n_good, n_bad):
    """One more file of lines."""
    good = f'{{"symbol": "s{k}", "timestamp": "2024-01-0{k + 1}T00:00:00+00:00"}}\n'
    (path / f"{k}.json").write_text(good * n_good + 'broken\n{"symbol": null}\n{}\n'[: 7 if n_bad == 1 else None] * (1 if n_bad else 0))


@pytest.fixture
def log(spark, tmp_path):
    listener = audits.AuditLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def run(spark, tmp_path, log):
    """What has landed; the query's id."""
    lines = streams.landed(spark, str(tmp_path / "lines"), feeds.HISTORY, "json", files_per_batch=1)
    query = streams.split_history(audits.observed(lines), str(tmp_path / "sinks"), str(tmp_path / "check"))
    query.awaitTermination()
    assert log.wait(query)
    return str(query.id)


def by_batch(spark, tmp_path):
    return sorted((r.batch, r.n_valid, r.n_corrupt) for r in audits.read_log(spark, str(tmp_path / "log")).collect())


def total(spark, tmp_path, query):
    return tuple(audits.totals(spark, str(tmp_path / "log"), str(tmp_path / "sinks"), query).first())


def test_counts_of_batches(spark, tmp_path, log):
    lines = tmp_path / "lines"
    lines.mkdir()
    land(lines, 0, 3, 3), land(lines, 1, 2, 0)
    query = run(spark, tmp_path, log)
    assert sorted(x[1:] for x in by_batch(spark, tmp_path)) == [(2, 0), (3, 3)]
    land(lines, 2, 0, 1)
    assert run(spark, tmp_path, log) == query
    assert by_batch(spark, tmp_path)[-1] == (2, 0, 1)
    assert total(spark, tmp_path, query) == (5, 4)
    # The last batch again, as after a crash before its commit: its line is replaced.
    for name in ("2", ".2.crc"):
        if (tmp_path / "check" / "commits" / name).exists():
            (tmp_path / "check" / "commits" / name).unlink()
    run(spark, tmp_path, log)
    assert len(by_batch(spark, tmp_path)) == 3 and total(spark, tmp_path, query) == (5, 4)
    # A driver lost before the listener heard of two batches: they are counted in the sinks.
    for n in (0, 2):
        os.remove(tmp_path / "log" / f"{query}-{n}.json")
    assert total(spark, tmp_path, query) == (5, 4)


def test_other_streams_and_nothing(spark, tmp_path, log):
    """A stream without these counts leaves no line; an empty folder gives zeros."""
    lines = tmp_path / "lines"
    lines.mkdir()
    query = run(spark, tmp_path, log)
    assert by_batch(spark, tmp_path) == [] and total(spark, tmp_path, query) == (0, 0)
    land(lines, 0, 1, 0)
    other = streams.split_history(streams.landed(spark, str(lines), feeds.HISTORY, "json"), str(tmp_path / "other"), str(tmp_path / "check2"))
    other.awaitTermination()
    assert log.wait(other) and by_batch(spark, tmp_path) == []
