"""One photometric solution over all frames and stars.

An observation (frame, star, m, w) is taken to be the star's magnitude plus the frame's zero point plus noise of
variance 1 / w. Least squares over all of them is one sparse system. The stars are eliminated (a star's magnitude is the weighted mean of
what its frames say), and conjugate gradients, preconditioned by the frames' weights, solve for the zero points. No matrix is
built: a round sends each frame's direction to its observations, averages it by star, sends that back and sums it by
frame. Vectors are tables in the shared folder, two scalars a round come to the driver, and a round's tables are
deleted when the next is written.

Only differences are determined: frames and stars that observations link form a component, and the zero points of its
frames have mean zero.

Scale: repeated observations are combined first; sums by star and by frame are combined before they are shuffled, so a
star in every frame is no hot key. Vectors of frames and of stars are broadcast up to ``BROADCAST`` rows, else joined by a shuffle.

Null and NaN magnitudes, null ids and weights that are not above zero are no observations; repeated rows count each
time; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeria.functions.columns import valued
from plumeria.functions.graph import min_reachable
from plumeria.functions.shared import delete, written

#: Rows of a vector (an id and a number) that are broadcast.
BROADCAST = 1_000_000


def zero_points(observations: DataFrame, tolerance: float = 1e-10, rounds: int = 500, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(frame_id, component, zero_point, n) and (star_id, component, magnitude, n) from rows (frame_id, star_id, m).

    ``weight`` names the column of weights (1 without it). It stops when the residual, in the norm of the preconditioner, has fallen to ``tolerance`` of
    what it was, and raises after ``rounds`` rounds. component is its smallest frame_id; n counts pairs of a frame and a star.
    """
    spark = observations.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = observations.select("frame_id", "star_id", F.col("m").cast("double").alias("m"), w.alias("w")).where("frame_id IS NOT NULL AND star_id IS NOT NULL AND w > 0")
    rows = valued(valued(rows, "m"), "w").groupBy("frame_id", "star_id").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("m"), F.sum("w").alias("w"))
    rows = written(rows, "observations")
    frames = written(rows.groupBy("frame_id").agg(F.sum("w").alias("d"), F.count("*").alias("n")), "frames")
    n_frames, n_stars = frames.count(), rows.select("star_id").distinct().count()
    of_frames = F.broadcast if n_frames <= BROADCAST else lambda df: df
    of_stars = F.broadcast if n_stars <= BROADCAST else lambda df: df

    def off_the_stars(values: DataFrame, value) -> DataFrame:
        """(frame_id, q): what each frame's ``value`` has, in sum, over the weighted means of its stars."""
        both = rows.join(of_frames(values), "frame_id").select("frame_id", "star_id", "w", value.alias("y"))
        mean = both.groupBy("star_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"))
        return both.join(of_stars(mean), "star_id").groupBy("frame_id").agg(F.sum(F.col("w") * (F.col("y") - F.col("mean"))).alias("q"))

    size = lambda df, e: df.agg(F.sum(e)).first()[0] or 0.0
    # with zero points of 0: the residual is what the magnitudes have over their stars' means
    residual = off_the_stars(frames.select("frame_id"), F.col("m")).withColumnRenamed("q", "r")
    kept: list[str] = []
    state = written(frames.join(of_frames(residual), "frame_id").select("frame_id", "d", F.lit(0.0).alias("z"), "r", (F.col("r") / F.col("d")).alias("p")), "round", kept)
    energy = first = size(state, F.col("r") * F.col("r") / F.col("d"))
    done = 0
    while energy > tolerance * tolerance * first:
        if done == rounds:
            raise RuntimeError(f"no solution within {rounds} rounds: the residual is {(energy / first) ** 0.5:.1e} of the first")
        paths: list[str] = []
        q = off_the_stars(state.select("frame_id", "p"), F.col("p"))
        now = written(state.join(of_frames(q), "frame_id"), "round", paths)
        along = size(now, F.col("p") * F.col("q"))
        if along <= 0:  # nothing is left but rounding
            delete(spark, paths)
            break
        step = energy / along
        r = F.col("r") - step * F.col("q")
        left = size(now, r * r / F.col("d"))
        state = now.select("frame_id", "d", (F.col("z") + step * F.col("p")).alias("z"), r.alias("r"), (r / F.col("d") + left / energy * F.col("p")).alias("p"))
        delete(spark, kept)
        kept, energy, done = paths, left, done + 1
    solved = written(state.select("frame_id", "z"), "solved")
    delete(spark, kept)
    first_frame = rows.groupBy("star_id").agg(F.min("frame_id").alias("first"))
    linked = min_reachable(rows.join(of_stars(first_frame), "star_id").select(F.col("frame_id").alias("a"), F.col("first").alias("b")))
    whole = solved.join(linked, solved["frame_id"] == linked["node"], "left").select("frame_id", F.coalesce("root", "frame_id").alias("component"), "z")
    whole = written(whole, "components")
    level = whole.groupBy("component").agg(F.avg("z").alias("level"))
    found = written(whole.join(level, "component").select("frame_id", "component", (F.col("z") - F.col("level")).alias("zero_point")), "zero-points")
    stars = rows.join(of_frames(found), "frame_id").groupBy("star_id").agg(
        F.min("component").alias("component"), (F.sum(F.col("w") * (F.col("m") - F.col("zero_point"))) / F.sum("w")).alias("magnitude"), F.count("*").alias("n")
    )
    return found.join(of_frames(frames.select("frame_id", "n")), "frame_id"), stars
