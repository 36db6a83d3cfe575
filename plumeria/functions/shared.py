"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder of this machine in local mode; elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumeria-{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def until_exit(spark: SparkSession, path: str) -> None:
    """Has Hadoop delete a folder that was written when the driver's JVM ends."""
    system, folder = _located(spark, path)
    system.deleteOnExit(folder)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more, and empties the list."""
    for path in paths:
        system, folder = _located(spark, path)
        system.delete(folder, True)
    paths.clear()


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and outlives lost executors.

    It stays until the application ends, as a result may read it at any time; ``paths`` gets its place, for :func:`delete`.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(spark, path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
