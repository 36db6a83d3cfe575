"""Frames as tables: compact arrays to pixel rows and back, and the tables of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(frames: DataFrame, width: int, frame: str = "frame_id", group: str = "group_id", data: str = "data") -> DataFrame:
    """(frame_id, group_id, x, y, v): a row for each value of the arrays. Null arrays give no rows."""
    rows = frames.select(F.col(frame).alias("frame_id"), F.col(group).alias("group_id"), F.posexplode(data).alias("pos", "v"))
    x, y = (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y")
    return rows.select("frame_id", "group_id", x, y, F.col("v").cast("double").alias("v"))


def arrays(rows: DataFrame, width: int) -> DataFrame:
    """(frame_id, group_id, data): pixel rows gathered to one array for each frame, in raster order."""
    at = F.col("y") * width + F.col("x")
    gathered = rows.groupBy("frame_id", "group_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "v"))).alias("p"))
    return gathered.select("frame_id", "group_id", F.transform("p", lambda p: p["v"]).alias("data"))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as frames of 8 x 8 pixels, grouped by label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("group_id"), F.col("embedding").alias("data"))
    return pixels(e, 8)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as a timestamp with time zone, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
