"""A background for every pixel: a mesh of tiles, clipped, filled and interpolated.

The mesh has the median of each square tile after values far from it are clipped away, pass by pass. Tiles without values
inside the frame's rectangle of tiles are holes; each takes the mean of the (up to eight) tiles around it that have one, round by round,
until none is left. Between the tiles' middles the surface is bilinear or bicubic (Catmull and Rom); beyond the outer middles
the outer tiles go on.

Scale: all clipping passes share one shuffle by tile, so a frame is spread over its tiles. A tile is sent to the few places of the mesh that
need it, and pixels, one row each, meet their place in an equi-join; the mesh is ``tile`` squared times smaller than the
pixels. Rounds of filling are written to the shared folder and end with the widest hole.

NaN and null values take no part in the mesh, but have a background like others. Rows without a coordinate or a frame, and frames
without any value, have none (null). Repeated rows stay repeated, all columns are kept (one of the name ``background`` is replaced), empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.columns import fresh, valued
from plumeria.functions.shared import delete, written

TILE = ["frame_id", "tx", "ty"]


def _tile(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("int")


def mesh(px: DataFrame, tile: int, k: float = 3.0, passes: int = 3) -> DataFrame:
    """(frame_id, tx, ty, level): the median of what is left of each tile after ``passes`` clips at k population deviations from the median."""
    rows = valued(px).where("frame_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").select("frame_id", _tile("x", tile).alias("tx"), _tile("y", tile).alias("ty"), F.col("v").cast("double").alias("v"))
    of_tile = Window.partitionBy(*TILE)
    for _ in range(passes):
        near = F.abs(F.col("v") - F.median("v").over(of_tile)) <= k * F.stddev_pop("v").over(of_tile)
        rows = rows.withColumn("near", near).where("near").drop("near")
    return rows.groupBy(*TILE).agg(F.median("v").alias("level"))


def filled(tiles: DataFrame) -> DataFrame:
    """The mesh without holes, with the frame's rectangle (x0, x1, y0, y1) in each row. Written."""
    spark = tiles.sparkSession
    frame = tiles.groupBy("frame_id").agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    every = frame.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("ty", F.explode(F.sequence("y0", "y1")))
    last: list[str] = []
    now = written(every.join(tiles, TILE, "left").select(*TILE, "x0", "x1", "y0", "y1", "level"), "mesh", last)
    while not now.where("level IS NULL").isEmpty():
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
        sent = now.where("level IS NOT NULL").select("frame_id", "tx", "ty", "level", F.explode(around).alias("d"))
        given = sent.groupBy("frame_id", (F.col("tx") + F.col("d.i")).alias("tx"), (F.col("ty") + F.col("d.j")).alias("ty")).agg(F.avg("level").alias("given"))
        paths: list[str] = []
        now = written(now.join(given, TILE, "left").withColumn("level", F.coalesce("level", "given")).drop("given"), "mesh", paths)
        delete(spark, last)
        last = paths
    return now


def _weights(f: Column, kind: str) -> dict[int, Column]:
    """Weights of the tiles at -1, 0, 1, 2 (0 and 1 for the bilinear form) of a place f between those at 0 and 1."""
    if kind == "bilinear":
        return {0: 1 - f, 1: f}
    return {-1: ((2 - f) * f - 1) * f / 2, 0: ((3 * f - 5) * f * f + 2) / 2, 1: ((4 - 3 * f) * f + 1) * f / 2, 2: (f - 1) * f * f / 2}


def background_surface(px: DataFrame, tile: int = 32, k: float = 3.0, passes: int = 3, kind: str = "bilinear") -> DataFrame:
    """px with ``background``: the surface's value at the pixel. ``kind``: bilinear or bicubic."""
    if tile < 1 or kind not in ("bilinear", "bicubic"):
        raise ValueError("tile is at least 1, kind bilinear or bicubic")
    reach = sorted(_weights(F.lit(0.0), kind))
    tiles = filled(mesh(px, tile, k, passes))
    # place (i, j) needs the tiles from i + reach[0] to i + reach[-1], held to the rectangle; each tile goes to the places that need it
    for axis, place, off, low, high in (("tx", "i", "di", "x0", "x1"), ("ty", "j", "dj", "y0", "y1")):
        tiles = tiles.withColumn(place, F.explode(F.sequence(F.col(axis) - 2, F.col(axis) + 2))).withColumn(off, F.explode(F.array(*map(F.lit, reach))))
        held = F.greatest(F.col(low), F.least(F.col(high), F.col(place) + F.col(off)))
        tiles = tiles.where((held == F.col(axis)) & F.col(place).between(F.col(low) - 1, F.col(high)))
    names = {(a, b): f"l{n}" for n, (a, b) in enumerate((a, b) for a in reach for b in reach)}
    of = lambda a, b: F.max(F.when((F.col("di") == a) & (F.col("dj") == b), F.col("level")))
    places = tiles.groupBy("frame_id", "i", "j").agg(*(of(a, b).alias(n) for (a, b), n in names.items()))
    kept = [c for c in px.columns if c.lower() != "background"]
    own = {c: fresh([*px.columns, *names.values(), "i", "j", "frame_id"], c) for c in ("u", "w", "pi", "pj", "mesh_frame")}
    middle = (tile - 1) / 2
    rows = px.withColumn(own["u"], (F.col("x") - middle) / tile).withColumn(own["w"], (F.col("y") - middle) / tile)
    rows = rows.withColumn(own["pi"], F.floor(own["u"]).cast("int")).withColumn(own["pj"], F.floor(own["w"]).cast("int"))
    inner = {c: fresh([*rows.columns], f"at_{c}") for c in ("i", "j", *names.values())}
    there = places.select(F.col("frame_id").alias(own["mesh_frame"]), *(F.col(c).alias(n) for c, n in inner.items()))
    met = rows.join(there, (F.col("frame_id") == F.col(own["mesh_frame"])) & (F.col(own["pi"]) == F.col(inner["i"])) & (F.col(own["pj"]) == F.col(inner["j"])), "left")
    across, along = (_weights(F.col(own[c]) - F.floor(own[c]), kind) for c in ("u", "w"))
    surface = sum((across[a] * along[b] * F.col(inner[n]) for (a, b), n in names.items()), F.lit(0.0))
    return met.select(*kept, surface.alias("background"))
