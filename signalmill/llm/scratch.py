"""Intermediate tables in the shared folder of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalmill.sources.landing import landing_dir as shared_dir


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them are lost."""
    discard(spark, shared_dir(spark).rpartition("/")[0])


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back, and where it is: lineage ends here,
    and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """``written`` for tables that stay until ``clean``."""
    return written(df, name)[0]
