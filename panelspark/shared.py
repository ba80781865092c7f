"""The folder that driver and executors share, and cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a fresh one on a local master, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put_file(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes one small file from the driver through Hadoop's file systems, so that executors find it in any shared folder; its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again, so that later steps read single columns.

    A checkpoint keeps the estimate of its plan's size; this table has the size of its files. In a loop
    with joins the estimates multiply from step to step, until the numbers alone fill the driver.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
