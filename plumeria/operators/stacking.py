"""Stacks: many values for each cell of a group combined into one, with outliers rejected.

All take pixel rows (frame_id, group_id, x, y, v) and shuffle them once, by the cell (those that
weigh or choose frames once more, by the frame; clipping to convergence sums up crowded cells instead); a group's cells are spread, so a group with most of
the frames is no hot spot. Quantiles and deviations are taken over the cell's window, so nothing is
joined back.

NaN and null values are left out. Cells without values are absent; a cell of one frame keeps its
value. Null keys are keys like others, repeated rows count each time, empty tables give no rows, and
other columns of px may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.columns import MAD_TO_SIGMA, fresh, valued
from plumeria.functions.shared import delete, written

CELL = ["group_id", "x", "y"]
FRAME = ["group_id", "frame_id"]
#: Clipping passes that share a shuffle where the number of passes is not known.
TOGETHER, MOST_TOGETHER = 4, 16
#: Values of a cell up to which its passes share a shuffle: as many as a window keeps without a page of memory (spark.sql.windowExec.buffer.in.memory.threshold).
CROWDED = 4096
#: Cells that are broadcast to the values.
BROADCAST = 2_000_000
MOMENTS = ["n", "lo", "hi", "mean", "spread"]


def _values(px: DataFrame) -> DataFrame:
    return valued(px).select("frame_id", *CELL, "v")


def basic_stack(px: DataFrame) -> DataFrame:
    return _values(px).groupBy(*CELL).agg(
        F.avg("v").alias("mean"),
        F.median("v").alias("median"),
        F.stddev_samp("v").alias("stddev"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.count("v").alias("n"),
    )


def sigma_clip(px: DataFrame, k: float = 2.0, passes: int = 2) -> DataFrame:
    """Rows (all columns) that survive ``passes`` rounds of dropping what is over k deviations from the cell's mean. One shuffle for all."""
    cell = Window.partitionBy(*CELL)
    rows = valued(px)
    m, s = (fresh(px.columns, c) for c in ("mean", "spread"))
    for _ in range(passes):
        rows = rows.withColumn(m, F.avg("v").over(cell)).withColumn(s, F.stddev_pop("v").over(cell))
        rows = rows.where(F.abs(F.col("v") - F.col(m)) <= k * F.col(s)).drop(m, s)
    return rows


def sigma_clip_stack(px: DataFrame, k: float = 2.0, passes: int = 2) -> DataFrame:
    return sigma_clip(px, k, passes).groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("v").alias("n"))


def sigma_clip_converged(px: DataFrame, k: float = 2.0) -> DataFrame:
    """Clips each cell until nothing is dropped; (value, n, passes), passes that dropped something.

    A pass that would drop all of a cell drops none. Cells of more than ``CROWDED`` values go by :func:`_clipped_by_ranges`, the others by
    :func:`_clipped_together`, whose windows hold a cell for each of their passes.
    """
    rows, paths = _values(px).select(*CELL, "v"), []
    full = rows.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    full = written(full.select(*CELL, F.monotonically_increasing_id().alias("cell")), "crowded", paths)
    n = full.count()
    if not n:
        delete(px.sparkSession, paths)
        return _clipped_together(rows, k)
    named = full.select(*(F.col(c).alias(f"_{c}") for c in CELL), "cell")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL]
    rows = written(rows.join(F.broadcast(named) if n <= BROADCAST else named, same, "left").select(*CELL, "v", "cell"), "values", paths)
    crowded = _clipped_by_ranges(rows.where("cell IS NOT NULL").select("cell", "v"), full, k)
    others = _clipped_together(rows.where("cell IS NULL").drop("cell"), k)
    delete(px.sparkSession, paths)
    return crowded.unionByName(others)


def _clipped_by_ranges(rows: DataFrame, cells: DataFrame, k: float) -> DataFrame:
    """:func:`sigma_clip_converged` of rows (cell, v), whatever a cell holds; cells has the columns of ``CELL`` for each cell number. Both are written.

    What a pass leaves of a cell are its values between two of them. So a pass sums up the rows between those that the pass before left, and only the
    ranges and moments, a row for each cell, go on to the next: no cell is gathered, sorted or shuffled.
    """
    spark, last, paths = rows.sparkSession, [], []
    left = [f(F.col("v")).alias(c) for c, f in (("_n", F.count), ("_lo", F.min), ("_hi", F.max), ("_mean", F.avg), ("_spread", F.stddev_pop))]
    far = F.abs(F.col("v") - F.col("mean")) > F.col("spread") * (k * (1 + 1e-15))
    first = rows.groupBy("cell").agg(*left).select("cell", *(F.col(f"_{c}").alias(c) for c in MOMENTS))
    state = written(cells.join(first, "cell").withColumns({"passes": F.lit(0), "open": F.lit(True)}), "ranges", last)
    small = F.broadcast if state.count() <= BROADCAST else lambda df: df
    while not state.where("open").isEmpty():
        by = state.where("open").select("cell", "lo", "hi", "mean", "spread")
        kept = rows.join(small(by), "cell").where(F.col("v").between(F.col("lo"), F.col("hi")) & ~far).groupBy("cell").agg(*left)
        changed = F.coalesce(F.col("open") & (F.col("_n") < F.col("n")), F.lit(False))
        now = {c: F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)) for c in MOMENTS}
        state = state.join(small(kept), "cell", "left").select("cell", *CELL, *(v.alias(c) for c, v in now.items()), (F.col("passes") + changed.cast("int")).alias("passes"), changed.alias("open"))
        state = written(state, "ranges", paths)
        delete(spark, last)
        last, paths = paths, []
    return state.select(*CELL, F.col("mean").alias("value"), "n", "passes")


def _clipped_together(rows: DataFrame, k: float) -> DataFrame:
    """:func:`sigma_clip_converged` of rows (the columns of ``CELL``, v): ``TOGETHER`` passes share a shuffle, then twice as many, up to ``MOST_TOGETHER``.

    What is left of the cells that the last of them still changed is written and goes on, the others are done. The windows of a task hold
    twice as many copies of a cell as there are passes, so cells have to be small: those up to ``CROWDED`` values take no memory page of their own.
    """
    spark, cell = rows.sparkSession, Window.partitionBy(*CELL)
    far = F.abs(F.col("v") - F.avg("v").over(cell)) > F.stddev_pop("v").over(cell) * (k * (1 + 1e-15))
    rows = rows.select(*CELL, "v", F.lit(0).alias("passes"), F.lit(True).alias("open"))
    done, paths, last, together = None, [], [], TOGETHER
    while True:
        for _ in range(together):
            rows = rows.withColumn("far", far).withColumn("dropped", F.count_if("far").over(cell)).withColumn("all", F.count("*").over(cell))
            changed = (F.col("dropped") > 0) & (F.col("dropped") < F.col("all"))
            rows = rows.where(~(F.col("far") & changed)).select(*CELL, "v", (F.col("passes") + changed.cast("int")).alias("passes"), changed.alias("open"))
        rows = written(rows, "clipped", paths)
        part = rows.where("not open").groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("*").alias("n"), F.max("passes").alias("passes"))
        part = written(part, "stacked")
        done = part if done is None else done.unionByName(part)
        rows, together = rows.where("open"), min(2 * together, MOST_TOGETHER)
        delete(spark, last)
        if rows.isEmpty():
            delete(spark, paths)
            return done
        last, paths = paths, []


def minmax_reject_stack(px: DataFrame, low: int = 1, high: int = 1) -> DataFrame:
    """Mean without the ``low`` smallest and ``high`` largest values of a cell (ties by frame)."""
    cell = Window.partitionBy(*CELL)
    rows = _values(px).withColumn("up", F.row_number().over(cell.orderBy("v", "frame_id")))
    rows = rows.withColumn("down", F.count("*").over(cell) - F.col("up") + 1)
    return rows.where((F.col("up") > low) & (F.col("down") > high)).groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def _with_quantiles(px: DataFrame, low: float, high: float) -> DataFrame:
    q = F.percentile("v", F.array(F.lit(low), F.lit(high))).over(Window.partitionBy(*CELL))
    return _values(px).withColumn("q", q).select(*CELL, "v", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def winsorised_stack(px: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    rows = _with_quantiles(px, low, high)
    return rows.groupBy(*CELL).agg(F.avg(F.greatest("lo", F.least("hi", "v"))).alias("value"), F.count("*").alias("n"))


def percentile_clip_stack(px: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    return _with_quantiles(px, low, high).where("v between lo and hi").groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def _with_median(px: DataFrame) -> DataFrame:
    return _values(px).withColumn("med", F.median("v").over(Window.partitionBy(*CELL)))


def median_absolute_deviation(px: DataFrame) -> DataFrame:
    rows = _with_median(px)
    return rows.groupBy(*CELL).agg(F.first("med").alias("median"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))


def mad_clip_stack(px: DataFrame, k: float = 3.0) -> DataFrame:
    """Mean of values within k robust deviations of the median."""
    away = F.abs(F.col("v") - F.col("med"))
    rows = _with_median(px).withColumn("mad", F.median(away).over(Window.partitionBy(*CELL)))
    return rows.where(away <= k * MAD_TO_SIGMA * F.col("mad")).groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def frame_levels(px: DataFrame) -> DataFrame:
    """(group_id, frame_id, level, spread) of each frame: median and population deviation."""
    return _values(px).groupBy(*FRAME).agg(F.median("v").alias("level"), F.stddev_pop("v").alias("spread"))


def weighted_stack(px: DataFrame) -> DataFrame:
    """Frames brought to level zero and weighted by inverse variance. Frames without spread have no weight."""
    frame = Window.partitionBy(*FRAME)
    rows = _values(px).withColumn("level", F.median("v").over(frame)).withColumn("spread", F.stddev_pop("v").over(frame))
    w = F.try_divide(F.lit(1.0), F.col("spread") * F.col("spread"))
    rows = rows.withColumn("w", w).withColumn("u", F.col("v") - F.col("level"))
    return rows.groupBy(*CELL).agg(F.try_divide(F.sum(F.col("u") * F.col("w")), F.sum("w")).alias("value"), F.sum("w").alias("weight"))


def select_frames(px: DataFrame, share: float = 0.5, score: Column | None = None) -> DataFrame:
    """Rows (all columns) of the frames with the lowest score (spread) in each group, ``share`` of them, rounded up; ties by frame.

    Frames without any value have no score and are not chosen. Ranks are taken over one row for each frame, not over pixels.
    """
    scored = frame_levels(px).withColumn("score", F.col("spread") if score is None else score)
    group = Window.partitionBy("group_id")
    ranked = scored.withColumn("rank", F.row_number().over(group.orderBy("score", "frame_id"))).withColumn("of", F.count("*").over(group))
    names = [fresh(px.columns, f"best_{c}") for c in FRAME]
    best = ranked.where(F.col("rank") <= F.ceil(F.col("of") * share)).select(*(F.col(c).alias(n) for c, n in zip(FRAME, names)))
    group, frame = (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(FRAME, names))
    return px.join(best, group & frame, "left_semi")


def selected_stack(px: DataFrame, share: float = 0.5) -> DataFrame:
    return _values(select_frames(px, share)).groupBy(*CELL).agg(F.avg("v").alias("value"), F.count("*").alias("n"))
