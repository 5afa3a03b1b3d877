"""Tables written between steps, in the shared folder that the cluster names.

``spark.checkpoint.dir`` names that folder.  Only where it is unset (tests, one
machine) the fallback below is used.  A written table cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK = "/tmp/checkpoints"
_written: list[tuple[object, object]] = []  # file system and path, which outlive the session


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return (named or FALLBACK).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{work_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cleanup() -> None:
    """Delete every intermediate table of this process; results read before stay valid only if collected or written."""
    while _written:
        files, path = _written.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            files.delete(path, True)


atexit.register(cleanup)
