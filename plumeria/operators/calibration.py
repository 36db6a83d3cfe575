"""Calibration: masters subtracted, divided and chosen; background tiles; hot cells repaired.

NaN counts as null. Null and absent values of a master leave a pixel as it is (subtraction) or null
(division); null pixels stay null, and take no part in masters, medians and deviations. Rows with a
null coordinate match no master and have no neighbours. Repeated rows stay repeated, empty tables give
no rows; the operators that return rows of px keep all its columns, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.columns import clean, fresh, valued
from plumeria.functions.shared import written

#: A master has one row for each cell; more rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_CELLS = 2_000_000


def master(px: DataFrame) -> DataFrame:
    """(x, y, value): the mean of the calibration frames in each cell. Written, as it is counted, averaged and joined."""
    return written(px.groupBy("x", "y").agg(F.avg(clean("v")).alias("value")), "master")


def _small(cells: DataFrame) -> DataFrame:
    """Broadcast where the number of cells is within the bound."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def _with_master(px: DataFrame, cells: DataFrame) -> tuple[DataFrame, str]:
    """px with the master's value beside it, and that column's name. The master has one row for each cell."""
    x, y, name = (fresh(px.columns, f"master_{c}") for c in ("x", "y", "value"))
    m = _small(cells.select(F.col("x").alias(x), F.col("y").alias(y), clean("value").alias(name)))
    return px.join(m, (F.col("x") == F.col(x)) & (F.col("y") == F.col(y)), "left").drop(x, y), name


def subtract_master(px: DataFrame, dark: DataFrame) -> DataFrame:
    """v less the master's value. Cells that the master lacks keep v."""
    rows, name = _with_master(px, dark)
    return rows.withColumn("v", clean("v") - F.coalesce(F.col(name), F.lit(0.0))).drop(name)


def divide_flat(px: DataFrame, flat: DataFrame) -> DataFrame:
    """v over the flat's value relative to its mean; null where the flat is zero or absent."""
    level = flat.agg(F.avg(clean("value"))).first()[0]
    rows, name = _with_master(px, flat)
    return rows.withColumn("v", F.try_divide(clean("v") * F.lit(level), F.col(name))).drop(name)


def nearest_by_scalar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, scalar: str, ranges: int | None = None) -> DataFrame:
    """(left_id, right_id, distance): for each left row the right row of the nearest scalar (ties: smaller id).

    Both sides are dealt out together by ranges of (scalar, ids), as many as there are shuffle partitions
    unless told otherwise, so equal scalars are split as well. Inside a range, a window finds the right
    rows next below and above; those of the other ranges come from a summary with one row for each range.
    No pair that is not an answer's neighbour is made. Null and NaN scalars match nothing, and neither do
    right rows with a null id; without any right row, left rows have null matches.
    """
    spark = left.sparkSession
    rows = left.select(F.col(left_id).alias("l"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("r"), F.col(scalar).alias("t"))
    ids = right.where(F.col(right_id).isNotNull()).select(F.lit(None).cast(left.schema[left_id].dataType).alias("l"), F.lit(False).alias("asks"), F.col(right_id).cast("long").alias("r"), F.col(scalar).alias("t"))
    rows = rows.unionByName(ids).where(F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double")))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written with its range, which must not change when a task runs again
    rows = written(rows.repartitionByRange(n, "t", "l", "r").withColumn("range", F.spark_partition_id()), "ranges")
    have = F.col("r").isNotNull()
    low = F.when(have, F.struct(F.col("t"), (-F.col("r")).alias("k")))  # of equal scalars, the smaller id is the larger struct
    high = F.when(have, F.struct(F.col("t"), F.col("r").alias("k")))
    by = Window.orderBy("range")  # one row for each range
    summary = rows.groupBy("range").agg(F.max(low).alias("top"), F.min(high).alias("bottom")).select(
        "range",
        F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("bottom").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    w = Window.partitionBy("range").orderBy("t")
    rows = rows.withColumn("below", F.max(low).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("above", F.min(high).over(w.rangeBetween(0, Window.unboundedFollowing)))
    rows = rows.where("asks").join(F.broadcast(summary), "range")
    below, above = F.greatest("below", "before"), F.least("above", "after")  # equal scalars may lie in two ranges
    options = F.array(
        F.when(below.isNotNull(), F.struct(F.abs(F.col("t") - below["t"]).alias("d"), (-below["k"]).alias("r"))),
        F.when(above.isNotNull(), F.struct(F.abs(F.col("t") - above["t"]).alias("d"), above["k"].alias("r"))),
    )
    return rows.select(F.col("l").alias(left_id), F.array_min(options).alias("n")).select(left_id, F.col("n.r").alias(right_id), F.col("n.d").alias("distance"))


def tile_background(px: DataFrame, tile: int = 4) -> DataFrame:
    """(frame_id, tx, ty, background): median of each square tile of a frame that has values."""
    t = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in ("x", "y")]
    return valued(px).groupBy("frame_id", *t).agg(F.median("v").alias("background"))


def neighbours(px: DataFrame, own: bool = False) -> DataFrame:
    """(frame_id, x, y, v, own): every value sent to the eight cells around it, and with ``own`` to its own cell, marked."""
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if own or dx or dy))
    sent = px.select("frame_id", "x", "y", "v", F.explode(around).alias("d"))
    return sent.select("frame_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "v", F.expr("d.dx = 0 AND d.dy = 0").alias("own"))


def hot_cells(px: DataFrame, k: float = 3.0) -> DataFrame:
    """(frame_id, x, y, v, repaired) of cells over k deviations (of the frame) away from the median of their neighbours."""
    px = valued(px).select("frame_id", "x", "y", "v")
    near = neighbours(px, own=True).where("x IS NOT NULL AND y IS NOT NULL").groupBy("frame_id", "x", "y").agg(
        F.median(F.when(~F.col("own"), F.col("v"))).alias("repaired"), F.collect_list(F.when(F.col("own"), F.col("v"))).alias("v")
    )  # a cell's own values are its repeated rows
    spread = px.groupBy("frame_id").agg(F.stddev_pop("v").alias("s"))
    rows = near.where("repaired IS NOT NULL").withColumn("v", F.explode("v")).join(spread, "frame_id")
    return rows.where(F.abs(F.col("v") - F.col("repaired")) > k * F.col("s")).select("frame_id", "x", "y", "v", "repaired")
