"""Sources: local maxima, segments, moments and frame quality.

NaN and null values are no pixels: they are no sources, have no neighbours and add to no sum. Rows with
a null frame or coordinate touch no other. One row for each pixel is expected; repeated pixels stay
repeated and are not maxima over each other. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.functions.columns import valued
from plumeria.functions.graph import min_reachable
from plumeria.operators.calibration import neighbours


def local_maxima_1d(px: DataFrame, width: int, threshold: float) -> DataFrame:
    """(frame_id, pos, v): values over the threshold and over both neighbours along the raster, which must be there.

    Each value is sent to the positions before and after it and met there, so a frame is spread by position.
    """
    rows = valued(px).select("frame_id", (F.col("y") * width + F.col("x")).alias("pos"), "v")
    sent = rows.select("frame_id", F.explode(F.array(*(F.struct((F.col("pos") + d).alias("pos"), F.lit(d).alias("d")) for d in (-1, 0, 1)))).alias("p"), "v")
    of = lambda d: F.max(F.when(F.col("p.d") == d, F.col("v")))
    met = sent.groupBy("frame_id", F.col("p.pos").alias("pos")).agg(of(0).alias("v"), of(1).alias("before"), of(-1).alias("after"), F.count_if(F.col("p.d") == 0).alias("n"))
    return met.where((F.col("n") == 1) & (F.col("v") > threshold) & (F.col("v") > F.col("before")) & (F.col("v") > F.col("after"))).select("frame_id", "pos", "v")


def local_maxima_2d(px: DataFrame, threshold: float) -> DataFrame:
    """(frame_id, group_id, x, y, v): values over the threshold and over all of the (up to eight) cells around them."""
    bright = valued(px).where(F.col("v") > threshold).select("frame_id", "group_id", "x", "y", "v")
    # a neighbour that is not over the threshold can't be the larger one
    near = neighbours(bright).groupBy("frame_id", "x", "y").agg(F.max("v").alias("around"))
    rows = bright.join(near, ["frame_id", "x", "y"], "left")
    return rows.where(F.col("around").isNull() | (F.col("v") > F.col("around"))).select("frame_id", "group_id", "x", "y", "v")


def segments(px: DataFrame, width: int, height: int, threshold: float) -> DataFrame:
    """(frame_id, x, y, source): cells over the threshold, joined with the touching ones (eight neighbours).

    source is the raster position of the segment's first cell.
    """
    at = (F.col("y").cast("long") * width + F.col("x")).alias("at")
    bright = valued(px).where(F.col("v") > threshold).select("frame_id", "x", "y", F.struct("frame_id", at).alias("cell"))
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    sent = bright.select("frame_id", F.col("cell").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(ahead).alias("d"))
    sent = sent.select("frame_id", "a", (F.col("x0") + F.col("d.dx")).alias("x"), (F.col("y0") + F.col("d.dy")).alias("y"))
    sent = sent.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    edges = sent.join(bright.withColumnRenamed("cell", "b"), ["frame_id", "x", "y"]).select("a", "b")
    roots = min_reachable(edges).withColumnRenamed("node", "cell")
    rows = bright.join(roots, "cell", "left")
    return rows.select("frame_id", "x", "y", F.coalesce("root", "cell").getField("at").cast("int").alias("source"))


def source_moments(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, flux, cx, cy, m2): total, centroid and mean squared radius, weighted by v. Null without flux."""
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    sums = valued(px).groupBy(*keys).agg(F.sum(v).alias("flux"), F.sum(v * x).alias("sx"), F.sum(v * y).alias("sy"), F.sum(v * (x * x + y * y)).alias("s2"))
    cx, cy = F.try_divide("sx", "flux"), F.try_divide("sy", "flux")
    return sums.select(*keys, "flux", cx.alias("cx"), cy.alias("cy"), (F.try_divide("s2", "flux") - cx * cx - cy * cy).alias("m2"))


def frame_quality(px: DataFrame, threshold: float) -> DataFrame:
    """(frame_id, sources, fwhm): how many maxima a frame has, and the mean width of the 3 x 3 cells around them."""
    peaks = local_maxima_2d(px, threshold).select("frame_id", F.col("x").alias("px"), F.col("y").alias("py"))
    box = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    cells = peaks.withColumn("d", F.explode(box)).select("frame_id", "px", "py", (F.col("px") + F.col("d.dx")).alias("x"), (F.col("py") + F.col("d.dy")).alias("y"))
    rows = cells.join(valued(px).select("frame_id", "x", "y", F.greatest("v", F.lit(0.0)).alias("v")), ["frame_id", "x", "y"])
    each = source_moments(rows, ["frame_id", "px", "py"])
    width = F.sqrt(F.greatest(F.col("m2") / 2, F.lit(0.0))) * 2.354820045  # of a round normal profile
    return each.groupBy("frame_id").agg(F.count("*").alias("sources"), F.avg(width).alias("fwhm"))
