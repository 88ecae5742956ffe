"""A shared folder for payloads that a job lands and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def landing_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine, as
    in tests, a folder of this machine is set for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/signalmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def land(lines: DataFrame, name: str) -> str:
    """Write a text column as files of lines, one payload each; the folder they are in."""
    path = f"{landing_dir(lines.sparkSession)}/{name}"
    lines.write.text(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends here, and what chance has decided stays as it is."""
    path = f"{landing_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
