"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset on a local master, a temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cairn-"))


def going_with_the_driver(spark: SparkSession, path: str) -> None:
    """Have the files of path deleted when the driver's JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: a loop's plan doesn't grow, a lost executor costs nothing, and joins see how
    large it is."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    going_with_the_driver(spark, path)
    return keep(spark.read.schema(df.schema).parquet(path), path)


def keep(df: DataFrame, written: str | DataFrame) -> DataFrame:
    """df, which is read from a written table as it is, known by that table's path."""
    df._cairn_path = written if isinstance(written, str) else getattr(written, "_cairn_path", None)
    return df


def gone(*tables: DataFrame) -> None:
    """Delete the files of written tables that no later step reads."""
    for df in tables:
        if path := getattr(df, "_cairn_path", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
