"""Counts that come with a stream's batches: observed as the rows pass, and kept by a listener."""

from __future__ import annotations

import json
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from signalmill.operators.history import is_valid
from signalmill.sources.landing import folder_names
from signalmill.streaming.posts import finished

#: A batch's counts: one line of the audit log.
AUDIT = "query string, batch long, n_valid long, n_corrupt long"
NAME = "history_audit"


def observed(lines: DataFrame) -> DataFrame:
    """A stream of history lines whose valid and other lines are counted as they pass; nothing is read for it again. The
    batch must be read once, as ``split_history`` does, since lines that pass twice count twice."""
    return lines.observe(NAME, F.count_if(is_valid()).alias("n_valid"), F.count_if(~is_valid()).alias("n_corrupt"))


class AuditLog(StreamingQueryListener):
    """Keeps what ``observed`` counts as a file of one line per batch below ``path``, on any file system. A batch that is
    repeated after a crash replaces its line. Other streams of the session are left alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(NAME)
        if seen is not None and seen.n_valid is not None and p.numInputRows:
            line = {"query": str(p.id), "batch": p.batchId, "n_valid": seen.n_valid, "n_corrupt": seen.n_corrupt}
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.id}-{p.batchId}.json")
            out = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
            try:
                out.write(bytearray(json.dumps(line).encode()))
            finally:
                out.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Until the log has all that an ended run counted: listeners hear of it a little later."""
        return self.ended.setdefault(str(query.runId), Event()).wait(seconds)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines, none if there aren't any."""
    return spark.read.schema(AUDIT).json(path) if folder_names(spark, path) else spark.createDataFrame([], AUDIT)


def totals(spark: SparkSession, log: str, sinks: str, query: str) -> DataFrame:
    """(n_valid, n_corrupt) of all whole batches below ``sinks``. A driver that is lost between a batch's commit and the
    listener's call leaves that batch out of the log; such batches alone are counted in the sinks."""
    known = read_log(spark, log).where(F.col("query") == query)
    logged = {r.batch for r in known.select("batch").distinct().collect()}  # a number a batch
    parts = known.select("n_valid", "n_corrupt")
    if lost := [n for n in finished(spark, sinks, "batch") if n not in logged]:
        rows = spark.read.schema("kind string").option("basePath", sinks).parquet(*[f"{sinks}/batch={n}" for n in lost])
        parts = parts.unionByName(rows.agg(F.count_if(F.col("kind") == "clean").alias("n_valid"), F.count_if(F.col("kind") == "quarantine").alias("n_corrupt")))
    return parts.agg(F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid"), F.coalesce(F.sum("n_corrupt"), F.lit(0)).alias("n_corrupt"))
