"""Where tables go that a run writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir); a folder of its own only
    in local mode without that setting. What is written there goes when the driver's JVM ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tripleweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/tripleweave/{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)
