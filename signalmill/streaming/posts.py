"""Streams of posts and snapshots: the batch rules of ``operators.history`` over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from signalmill.operators.history import DAILY_CAP, SOFT_HOURS, admit, is_valid, micros
from signalmill.sources.feeds import HISTORY
from signalmill.sources.landing import folder_names


def landed(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files as they land, each once."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


class InOrder(StatefulProcessor):
    """Rules that decide the posts of a key one after the other in the order of (at, id), whatever batches they come
    in: posts wait in the state until the watermark has passed them, since nothing earlier can come then. ``at`` is in
    microseconds. Time is that of the posts alone, never the machine's; a timer wakes a key when its next post is due or
    when nothing that it remembers can matter any more. Posts behind the watermark are left out."""

    waiting_schema = "at long, id long, symbol string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark(timerValues)
        new = [x for pdf in rows for x in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["symbol"].tolist()) if x[0] > mark and x[1] == x[1]]
        return self.settle(key, mark, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.settle(key, self.mark(timerValues), [])

    @staticmethod
    def mark(timerValues) -> int:
        """The watermark in microseconds."""
        return timerValues.getCurrentWatermarkInMs() * 1000

    def settle(self, key, mark: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        """Decide what the watermark has passed and say when to go on."""
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *new], key=lambda x: x[:2])
        due = sum(x[0] <= mark for x in rows)
        admitted, left, ends = self.decide(key, rows[:due], rows[due:], mark)
        if left:
            self.waiting.put([(int(a), int(i), s) for a, i, s in left])
        elif self.waiting.exists():
            self.waiting.clear()
        times = {-(-at // 1000) for at in [*(x[0] for x in left[:1]), *ends]}
        for at in times - set(self.handle.listTimers()):
            self.handle.registerTimer(at)
        if admitted:
            yield pd.DataFrame({"id": [int(x[1]) for x in admitted], "symbol": [x[2] for x in admitted], "at": [int(x[0]) for x in admitted]})

    def decide(self, key, due: list[tuple], later: list[tuple], mark: int) -> tuple[list[tuple], list[tuple], list[int]]:
        """Which of the posts that are due are admitted, which of the later ones still wait, and when state ends."""
        raise NotImplementedError

    def close(self) -> None:
        pass


OUT = "id long, symbol string, at long"


def in_order(rows: DataFrame, key: str, rule: StatefulProcessor, delay: str) -> DataFrame:
    """Run a rule per key over rows (id, symbol, at, and the key); needs the RocksDB state store. Rows without an id have
    keys below 0; they get one, since a null in a batch would make doubles of its ids."""
    timed = rows.withColumns({"id": F.coalesce("id", F.lit(0)), "created_at": F.timestamp_micros("at")}).withWatermark("created_at", delay)
    out = timed.groupBy(key).transformWithStateInPandas(rule, OUT, "append", "eventTime")
    return out.select("id", "symbol", F.timestamp_micros("at").alias("created_at"))


def _timed(posts: DataFrame) -> DataFrame:
    return posts.select("id", "symbol", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")).where("at is not null")


#: Keys that symbols are dealt to. A checkpoint holds state by them, so the number stays as it is for one.
BUCKETS = 1024
_CHUNK = pa.schema([("symbol", pa.string()), ("at", pa.int64()), ("id", pa.int64())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


class Cooldown(StatefulProcessor):
    """Per symbol the last admitted time; it goes when the watermark has passed the end of its cooldown.

    A key holds many symbols, as each call to the state costs far more than a post does. A batch's posts are added to the
    state as one packed chunk and nothing is read; posts are decided by (at, id) when the watermark has passed them, since
    nothing earlier can come then. One timer wakes a key, for the earliest post that waits or the earliest end of a cooldown.
    Time is that of the posts alone, never the machine's. Posts behind the watermark are left out, as is all of key -1."""

    def __init__(self, hours: float):
        self.gap = micros(hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "posts binary")
        self.last = handle.getListState("last", "symbol string, at long")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, at: int | None) -> None:
        """Keep one timer, at the given time in microseconds or the one that is earlier."""
        held = self.timer.get()
        ms = None if at is None else -(-at // 1000)
        if ms is None or (held is not None and held[0] <= ms):
            return
        if held is not None:
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = InOrder.mark(timerValues)
        new = [pa.Table.from_pandas(pdf.loc[pdf["at"] > mark, _CHUNK.names], _CHUNK, preserve_index=False) for pdf in rows if key[0] >= 0]
        new = pa.concat_tables([_CHUNK.empty_table(), *new])
        if new.num_rows:
            self.waiting.appendValue((_packed(new),))
            self.wake(pc.min(new["at"]).as_py())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = InOrder.mark(timerValues)
        held = pa.concat_tables([_CHUNK.empty_table(), *(pa.ipc.open_stream(bytes(x[0])).read_all() for x in self.waiting.get())])
        last = dict(self.last.get())
        passed = pc.less_equal(held["at"], mark)
        out, later = self.decide(held.filter(passed), last), held.filter(pc.invert(passed))
        last = {symbol: at for symbol, at in last.items() if at + self.gap > mark}
        for state, values in ((self.waiting, [(_packed(later),)] if later.num_rows else []), (self.last, list(last.items()))):
            if values:
                state.put(values)
            else:
                state.clear()
        self.timer.clear()
        self.wake(min([*([pc.min(later["at"]).as_py()] if later.num_rows else []), *(at + self.gap for at in last.values())], default=None))
        if out.num_rows:
            yield out.select(["id", "symbol", "at"]).to_pandas()

    def decide(self, due: pa.Table, last: dict[str, int]) -> pa.Table:
        """The posts that are admitted; ``last`` goes on to each symbol's last one."""
        if not due.num_rows:
            return due
        due = due.sort_by([("symbol", "ascending"), ("at", "ascending"), ("id", "ascending")]).combine_chunks()
        symbols, times = due["symbol"].combine_chunks().dictionary_encode(), due["at"].to_numpy()
        codes, names = symbols.indices.to_numpy(), symbols.dictionary.to_pylist()
        cut, ok = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)], np.zeros(len(codes), dtype=bool)
        for a, b in zip(cut[:-1], cut[1:]):
            name = names[codes[a]]
            ok[a:b], end = admit(times[a:b], last.get(name), self.gap)
            if end is not None:
                last[name] = end
        return due.filter(pa.array(ok))

    def close(self) -> None:
        pass


def cooldown(posts: DataFrame, hours: float = SOFT_HOURS, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Posts (id, symbol, created_at) that each symbol's cooldown admits, across batches and runs: the same ones as
    ``sequential_cooldown`` for any files, batches and pauses, as long as no post comes later than ``delay`` behind the
    latest. A post comes out when the watermark has passed it. Rows without an id only move the watermark on; rows
    without symbol or time are left out."""
    bucket = F.when(F.col("id").isNull() | F.col("symbol").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("symbol"), F.lit(buckets))).cast("long")
    return in_order(_timed(posts).select(bucket.alias("bucket"), "id", "symbol", "at"), "bucket", Cooldown(hours), delay)


DAY = 86_400_000_000


class DailyCap(InOrder):
    """Per day how many posts have been sent, and of the waiting ones no more than may still follow. All of it goes
    when the watermark has passed the day's end; what comes for the day after that is behind the watermark, so that
    no day counts anew."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sent = handle.getValueState("sent", "n int")

    def decide(self, key, due, later, mark):
        if key[0] < 0:
            return [], [], []
        used, end = self.sent.get()[0] if self.sent.exists() else 0, (int(key[0]) + 1) * DAY
        out = due[: max(0, self.cap - used)]
        used += len(out)
        if mark >= end:
            self.sent.clear()
            return out, [], []
        self.sent.update((used,))
        return out, later[: max(0, self.cap - used)], [end]


def first_of_days(rows: DataFrame, cap: int) -> DataFrame:
    """Each task's first ``cap`` rows of a day (day, id, symbol, at), so that no more of a day than tasks times cap
    reach its key; a task holds its days' rows. Of the rows of day -1 the last one is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            both = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            both = both.sort_by([("day", "ascending"), ("at", "ascending"), ("id", "ascending")])
            day = both["day"].to_numpy()
            place, after = np.arange(len(day)) - np.searchsorted(day, day), np.searchsorted(day, day, side="right") - np.arange(len(day))
            held = both.filter(pa.array(np.where(day < 0, after == 1, place < cap))).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def daily_cap(posts: DataFrame, cap: int = DAILY_CAP, delay: str = "1 hour") -> DataFrame:
    """The first ``cap`` posts of each UTC day by (created_at, id), across batches and runs: the same ones as ``within_cap``
    for any files, batches and pauses, as long as no post comes later than ``delay`` behind the latest. A post comes out
    when the watermark has passed it. Rows without an id only move the watermark on; rows without a time are left out."""
    day = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.floor(F.col("at") / F.lit(DAY))).cast("long")
    rows = _timed(posts).select(day.alias("day"), "id", "symbol", "at")
    return in_order(first_of_days(rows, cap), "day", DailyCap(cap), delay)


def first_signatures(posts: DataFrame, delay: str = "48 hours") -> DataFrame:
    """Posts whose content signature hasn't come up within the watermark."""
    return posts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["signature"])


def split_history(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of history lines to two sinks below ``path``: valid ones to kind=clean, others to kind=quarantine. A batch writes
    both in one job under its number, and a repeated batch writes its number again, so neither has a line twice."""

    def split(batch: DataFrame, number: int) -> None:
        kind = F.when(is_valid(), "clean").otherwise("quarantine")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_history_sink(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The lines of one sink, from batches that are whole."""
    batches = [f"{path}/batch={n}" for n in finished(spark, path, "batch")]
    if not batches:
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(f"{HISTORY}, kind string").option("basePath", path).parquet(*batches).where(F.col("kind") == kind).drop("kind")


def keep_latest(snapshots: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, merge_every: int = 50) -> StreamingQuery:
    """Maintain the newest snapshot row of each symbol (symbol, ts, ...) below ``path``; ``read_latest`` reads it.

    A batch writes only its own symbols' newest rows, under its number; a repeated batch writes its own number
    again. Every ``merge_every`` batches what there is becomes one table, and the batches in it are deleted
    with the next merge, so that readers of the old state can end.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % merge_every == merge_every - 1:
            had = finished(spark, path, "merged")
            read_latest(spark, path, upto=number).write.mode("overwrite").parquet(f"{path}/merged={number}")
            before = max((n for n in had if n < number), default=None)
            if before is not None:
                for kind in ("merged", "batch"):
                    for n in finished(spark, path, kind):
                        if n < before or (kind == "batch" and n == before):
                            _delete(spark, f"{path}/{kind}={n}")

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(rows: DataFrame) -> DataFrame:
    """Each symbol's row with the latest ts."""
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rows.columns), F.col("ts")).alias("row")).select("row.*")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Of the finished tables of a kind."""
    names = [n for n in folder_names(spark, path) if n.startswith(f"{kind}=")]
    return sorted(int(n.partition("=")[2]) for n in names if "_SUCCESS" in folder_names(spark, f"{path}/{n}"))


def read_latest(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest row of each symbol that ``keep_latest`` has written: the last merged table and later batches."""
    merged = [n for n in finished(spark, path, "merged") if upto is None or n < upto]
    base = merged[-1] if merged else -1
    batches = [n for n in finished(spark, path, "batch") if n > base and (upto is None or n <= upto)]
    return newest(spark.read.parquet(*[f"{path}/merged={n}" for n in merged[-1:]], *[f"{path}/batch={n}" for n in batches]))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table; the default trigger takes what has landed and stops. State is kept in
    RocksDB."""
    spark = rows.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
    finally:
        spark.conf.set(STATE_STORE, before)
