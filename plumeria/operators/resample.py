"""Resampling onto a common grid, mosaics, histograms and stretches.

NaN and null values are no pixels: they add neither value nor coverage. Frames without a transform and
groups without an offset are left out. Repeated rows count each time, empty tables give no rows; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.columns import clean, valued

#: A coverage below this is rounding of outlines, not overlap.
NEGLIGIBLE = 1e-12


def bilinear_resample(px: DataFrame, transform: DataFrame, least: float = 0.0) -> DataFrame:
    """(group_id, x, y, value, coverage): pixels moved by (frame_id, a, b, tx, ty) and shared among the four cells they fall on.

    Flux is kept: the weights of a pixel add up to one. Cells with a coverage of ``least`` or less are left out: with transforms that were
    fitted, a coverage near zero is rounding, and its value says nothing. transform has one row for each frame.
    """
    rows = valued(px).select("frame_id", "group_id", "x", "y", "v").join(transform.select("frame_id", "a", "b", "tx", "ty").dropna(), "frame_id")
    u = (F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx")).alias("u")
    v = (F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty")).alias("w")
    rows = rows.select("group_id", "v", u, v).withColumn("i", F.floor("u")).withColumn("j", F.floor("w"))
    fx, fy = F.col("u") - F.col("i"), F.col("w") - F.col("j")
    parts = F.array(
        *(F.struct((F.col("i") + di).alias("x"), (F.col("j") + dj).alias("y"), ((fx if di else 1 - fx) * (fy if dj else 1 - fy)).alias("c")) for di in (0, 1) for dj in (0, 1))
    )
    cells = rows.select("group_id", "v", F.explode(parts).alias("p")).where("p.c > 0")
    c = F.col("p.c")
    cells = cells.groupBy("group_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.try_divide(F.sum(F.col("v") * c), F.sum(c)).alias("value"), F.sum(c).alias("coverage"))
    return cells.where(F.col("coverage") > least)


def with_area(rows: DataFrame, name: str) -> DataFrame:
    """rows with what an edge (x0, y0) to (x1, y1) adds to the area that its polygon shares with the unit cell around (i, j).

    By Green's theorem: the area under the edge, with its ends held to the cell's sides and its height to the cell. Summed around a
    polygon, corners counter-clockwise, it is the exact overlap but for rounding, without a clipped outline.
    """
    kept, c = rows.columns, F.col
    held = lambda x, low, high: F.greatest(low, F.least(high, x))
    slope = (c("y1") - c("y0")) / F.nullif(c("x1") - c("x0"), F.lit(0.0))

    def height(x: Column) -> Column:
        """Above the cell's lower side, from the nearer corner, so that a corner inside the cell keeps its own."""
        first = F.abs(x - c("x0")) <= F.abs(x - c("x1"))
        return F.when(first, c("y0") + (x - c("x0")) * c("_slope")).otherwise(c("y1") + (x - c("x1")) * c("_slope")) - c("j") + 0.5

    rows = rows.withColumns({"_slope": slope, "_a": held(c("x0"), c("i") - 0.5, c("i") + 0.5), "_b": held(c("x1"), c("i") - 0.5, c("i") + 0.5)})
    rows = rows.withColumns({"_ha": height(c("_a")), "_hb": height(c("_b"))})
    rows = rows.withColumns({"_l": F.least("_ha", "_hb"), "_h": F.greatest("_ha", "_hb")})
    rows = rows.withColumns({f"_{k}c": held(c(f"_{k}"), F.lit(0.0), F.lit(1.0)) for k in "lh"})
    over = F.greatest(F.lit(0.0), c("_h") - 1) - F.greatest(F.lit(0.0), c("_l") - 1)
    mean = F.coalesce(((c("_hc") - c("_lc")) * (c("_hc") + c("_lc")) / 2 + over) / F.nullif(c("_h") - c("_l"), F.lit(0.0)), c("_lc"))
    return rows.select(*kept, F.coalesce((c("_a") - c("_b")) * mean, F.lit(0.0)).alias(name))  # upright edges have no slope and no width


def drizzle(px: DataFrame, transform: DataFrame, pixfrac: float = 1.0, scale: float = 1.0) -> DataFrame:
    """(group_id, x, y, value, coverage, flux): pixels shrunk to drops and laid on a grid of ``scale`` cells a pixel.

    A pixel is the unit square around (x, y). It is shrunk to ``pixfrac`` of its side (above 0, at most 1), moved by
    (frame_id, a, b, tx, ty) as in :func:`bilinear_resample`, and shared among all cells that the rotated square meets, by exact
    overlap (summed edge by edge in the aggregation): as many cells as its size asks for. coverage is the sum of the shares of pixels that fell on the cell, value their
    mean by share, flux the sum of value times share: over all cells as much as over all pixels. Cells with a coverage
    below ``NEGLIGIBLE`` are left out. Without rotation and at pixfrac 1 and scale 1 value and coverage are those of the bilinear resampling.
    A transform of size zero leaves its frame out. transform has one row for each frame.
    """
    if not 0 < pixfrac <= 1 or scale <= 0:
        raise ValueError("pixfrac is above 0 and at most 1, scale above 0")
    t = transform.select("frame_id", *((F.col(c) * scale).alias(c) for c in ("a", "b", "tx", "ty"))).dropna().where("a * a + b * b > 0")
    rows = valued(px).select("frame_id", "group_id", "x", "y", "v").join(t, "frame_id")
    u, w = F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx"), F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty")
    half = pixfrac / 2
    rows = rows.select("group_id", "v", u.alias("u"), w.alias("w"), (F.col("a") * half).alias("p"), (F.col("b") * half).alias("q"))
    reach = F.abs("p") + F.abs("q")  # half of the bounding box
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(c) - reach + 0.5), F.floor(F.col(c) + reach + 0.5)))
    rows = rows.select("*", cells("u").alias("i")).select("*", cells("w").alias("j"))
    p, q = F.col("p"), F.col("q")
    corners = [(F.col("u") + dx * p - dy * q, F.col("w") + dx * q + dy * p) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    edges = F.array(*(F.struct(*(x.alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), (*corners[k - 1], *corners[k])))) for k in range(4)))
    rows = with_area(rows.select("v", "group_id", "i", "j", "p", "q", F.inline(edges)), "area")
    share = F.col("area") / (4 * (p * p + q * q))
    rows = rows.select("group_id", "v", F.col("i").alias("x"), F.col("j").alias("y"), share.alias("c"))
    flux = F.sum(F.col("v") * F.col("c"))
    cells = rows.groupBy("group_id", "x", "y").agg(F.try_divide(flux, F.sum("c")).alias("value"), F.sum("c").alias("coverage"), flux.alias("flux"))
    return cells.where(F.col("coverage") > NEGLIGIBLE)


def mosaic(stacks: DataFrame, offsets: DataFrame) -> DataFrame:
    """(x, y, value, weight): stacks (group_id, x, y, value, weight) placed at (group_id, dx, dy), overlaps averaged by weight."""
    placed = valued(stacks, "value").join(offsets.select("group_id", "dx", "dy"), "group_id").select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "value", "weight")
    return placed.groupBy("x", "y").agg(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))


def histogram(px: DataFrame, low: float, high: float, bins: int, *more: Column) -> DataFrame:
    """(bucket, n): 0 is below low, bins + 1 at high or above. ``more``: other aggregates of a bucket's rows."""
    return valued(px).groupBy(F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *more)


def asinh_stretch(v: Column, softness: float) -> Column:
    return F.asinh(clean(v) / softness) / F.asinh(F.lit(1 / softness))
