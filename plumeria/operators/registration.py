"""Registration: catalogues matched, triangles voted on, transforms and scales fitted.

NaN and null brightness or coordinates are no stars and fit nothing. Repeated stars count each time,
empty tables give no rows; other columns play no part. A frame's stars are few, and its triangles meet
in one row; pixels and frames are spread by their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.columns import valued
from plumeria.operators.nearest import within

#: Rows of a cell up to which a cross-match joins cells as they are.
CROWDED = 50_000


def cross_match(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, d2): pairs of (id, cx, cy) within the radius, found by an equi-join on cells of its size.

    Where one cell holds more than ``CROWDED`` rows of b, by the leaves of :mod:`plumeria.operators.nearest` instead, which part a crowded cell.
    """
    a, b = (valued(valued(c, "cx"), "cy") for c in (a, b))
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    fullest = b.groupBy(cell("cx").alias("i"), cell("cy").alias("j")).count().agg(F.max("count")).first()[0] or 0
    if fullest > CROWDED:
        return within(a, b, radius)
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = a.select(F.col("id").alias("a_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(around).alias("o"))
    left = left.select("a_id", "ax", "ay", (cell("ax") + F.col("o.i")).alias("i"), (cell("ay") + F.col("o.j")).alias("j"))
    right = b.select(F.col("id").alias("b_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    right = right.withColumn("i", cell("bx")).withColumn("j", cell("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return left.join(right, ["i", "j"]).select("a_id", "b_id", (dx * dx + dy * dy).alias("d2")).where(F.col("d2") <= radius * radius)


def brightest(px: DataFrame, n: int = 6) -> DataFrame:
    """(group_id, frame_id, rank, x, y, v): the n largest values of each frame, ties by raster position."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("v"), "y", "x")
    rows = valued(px).select("group_id", "frame_id", F.row_number().over(w).alias("rank"), "x", "y", "v")
    return rows.where(F.col("rank") <= n)


def triangles(stars: DataFrame) -> DataFrame:
    """(group_id, frame_id, d, s): all triangles of a frame's stars: squared sides from the shortest on, and the stars (rank, x, y) opposite to them."""
    star = F.struct("rank", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    spots = stars.groupBy("group_id", "frame_id").agg(F.array_sort(F.collect_list(star)).alias("s"))
    pairs = spots.select("group_id", "frame_id", "s", F.posexplode("s").alias("i", "p"))
    pairs = pairs.select("group_id", "frame_id", "s", "i", "p", F.posexplode("s").alias("j", "q")).where("j > i")
    three = pairs.select("group_id", "frame_id", "j", "p", "q", F.posexplode("s").alias("k", "r")).where("k > j")
    far = lambda a, b, c: (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    side = lambda a, b, over: F.struct((far(a, b, "x") + far(a, b, "y")).alias("d"), F.col(over).alias("s"))
    three = three.select("group_id", "frame_id", F.array_sort(F.array(side("p", "q", "r"), side("p", "r", "q"), side("q", "r", "p"))).alias("t"))
    return three.select("group_id", "frame_id", F.col("t.d").alias("d"), F.col("t.s").alias("s"))


def triangle_pairs(stars: DataFrame, bins: int = 20) -> DataFrame:
    """(group_id, frame_id, s, ref): triangles of each frame with those of its group's first frame of like shape.

    Alike are shapes whose two ratios of squared sides to the longest differ by at most 1 / bins. They meet by
    bins of that width: a reference shape is filed under its own and the neighbouring ones. Degenerate
    triangles (a longest side of zero) have no shape.
    """
    shapes = triangles(stars).where("d[2] > 0")
    q = [F.expr(f"cast(d[{i}] * {bins} div d[2] as int)") for i in (0, 1)]
    first = stars.groupBy("group_id").agg(F.min("frame_id").alias("frame_id"))
    around = F.array(*(F.struct((q[0] + i).alias("q1"), (q[1] + j).alias("q2")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    ref = shapes.join(first, ["group_id", "frame_id"], "left_semi").select("group_id", F.col("d").alias("e"), F.col("s").alias("ref"), F.inline(around).alias("q1", "q2"))
    others = shapes.join(first, ["group_id", "frame_id"], "left_anti").select("group_id", "frame_id", "d", "s", q[0].alias("q1"), q[1].alias("q2"))
    near = lambda i: F.expr(f"abs(d[{i}] * e[2] - e[{i}] * d[2]) * {bins} <= d[2] * e[2]")
    return others.join(ref, ["group_id", "q1", "q2"]).where(near(0) & near(1)).select("group_id", "frame_id", "s", "ref")


def triangle_votes(stars: DataFrame, bins: int = 20) -> DataFrame:
    """(group_id, frame_id, votes): pairs of a triangle of the frame and one of its group's first frame that are alike."""
    return triangle_pairs(stars, bins).groupBy("group_id", "frame_id").agg(F.count("*").alias("votes"))


def voted_pairs(stars: DataFrame, bins: int = 20) -> DataFrame:
    """(frame_id, x, y, u, v): stars of each frame with stars (u, v) of its group's first frame, as their triangles vote.

    Alike triangles pair their corners (those opposite to the shortest, middle and longest sides). A pair of stars
    stands if it has the most votes of both of its stars; ties go to the smaller ranks. The first frame pairs with itself.
    """
    corner = F.explode(F.arrays_zip("s", "ref")).alias("c")
    votes = triangle_pairs(stars, bins).select("group_id", "frame_id", corner).groupBy("frame_id", F.col("c.s").alias("s"), F.col("c.ref").alias("ref")).count()
    order = [F.desc("count"), "s.rank", "ref.rank"]
    best = lambda side: F.row_number().over(Window.partitionBy("frame_id", side).orderBy(*order))
    votes = votes.withColumn("of_s", best("s")).withColumn("of_ref", best("ref")).where("of_s = 1 and of_ref = 1")
    first = stars.groupBy("group_id").agg(F.min("frame_id").alias("frame_id"))
    own = stars.join(first, ["group_id", "frame_id"], "left_semi").select("frame_id", "x", "y", F.col("x").alias("u"), F.col("y").alias("v"))
    return votes.select("frame_id", "s.x", "s.y", F.col("ref.x").alias("u"), F.col("ref.y").alias("v")).unionByName(own)


def similarity_transform(pairs: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, a, b, tx, ty): least squares of u = a x - b y + tx, v = b x + a y + ty over pairs (key, x, y, u, v), from sums."""
    x, y, u, v = (F.col(c).cast("double") for c in "xyuv")
    for c in (x, y, u, v):
        pairs = pairs.where(c.isNotNull() & ~F.isnan(c))
    s = pairs.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(u).alias("su"), F.sum(v).alias("sv"),
        F.sum(x * x + y * y).alias("sq"), F.sum(x * u + y * v).alias("dot"), F.sum(x * v - y * u).alias("cross"),
    )
    c = {k: F.col(k) for k in s.columns}
    size = c["sq"] - (c["sx"] * c["sx"] + c["sy"] * c["sy"]) / c["n"]
    a = F.try_divide(c["dot"] - (c["sx"] * c["su"] + c["sy"] * c["sv"]) / c["n"], size)
    b = F.try_divide(c["cross"] - (c["sx"] * c["sv"] - c["sy"] * c["su"]) / c["n"], size)
    s = s.withColumn("a", a).withColumn("b", b)
    tx = (F.col("su") - F.col("a") * F.col("sx") + F.col("b") * F.col("sy")) / F.col("n")
    ty = (F.col("sv") - F.col("b") * F.col("sx") - F.col("a") * F.col("sy")) / F.col("n")
    return s.select(key, "a", "b", tx.alias("tx"), ty.alias("ty"))


def rank_pairs(stars: DataFrame) -> DataFrame:
    """(frame_id, x, y, u, v): each frame's stars paired by rank with those of its group's first frame."""
    first = stars.groupBy("group_id").agg(F.min("frame_id").alias("frame_id"))
    ref = stars.join(first, ["group_id", "frame_id"], "left_semi").select("group_id", "rank", F.col("x").alias("u"), F.col("y").alias("v"))
    return stars.select("group_id", "frame_id", "rank", "x", "y").join(ref, ["group_id", "rank"]).select("frame_id", "x", "y", "u", "v")


def photometric_scale(px: DataFrame) -> DataFrame:
    """(frame_id, slope, intercept, r): each frame fitted to the mean of its group, cell by cell."""
    mean = F.avg("v").over(Window.partitionBy("group_id", "x", "y"))
    rows = valued(px).select("frame_id", "v", mean.alias("m"))
    return rows.groupBy("frame_id").agg(F.regr_slope("v", "m").alias("slope"), F.regr_intercept("v", "m").alias("intercept"), F.corr("v", "m").alias("r"))
