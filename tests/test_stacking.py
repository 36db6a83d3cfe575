import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumeria.functions import shared
from plumeria.operators import calibration, detection, registration, resample, stacking, timeline
from plumeria.sources import frames


def px(spark, values, group=0, x=0, y=0):
    rows = [(i, group, x, y, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "frame_id long, group_id int, x int, y int, v double")


def one(df):
    return df.collect()[0].asDict()


def image(spark, cells, frame=0):
    rows = [(frame, 0, x, y, float(v)) for y, line in enumerate(cells) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame_id long, group_id int, x int, y int, v double")


def test_basic_stack_skips_nan_and_null(spark):
    assert one(stacking.basic_stack(px(spark, [1, 3, None, float("nan")]))) == {"group_id": 0, "x": 0, "y": 0, "mean": 2.0, "median": 2.0, "stddev": pytest.approx(2**0.5), "min": 1.0, "max": 3.0, "n": 2}


def test_one_frame_survives_every_rejection(spark):
    for f in (stacking.sigma_clip_stack, stacking.sigma_clip_converged, stacking.mad_clip_stack, stacking.winsorised_stack, stacking.percentile_clip_stack):
        assert one(f(px(spark, [7])))["value"] == 7.0, f.__name__


def test_sigma_clip_drops_the_outlier(spark):
    values = [1, 1.1, 0.9, 1, 1.05, 0.95, 1, 100]
    assert one(stacking.sigma_clip_stack(px(spark, values)))["n"] == 7
    r = one(stacking.sigma_clip_converged(px(spark, values)))
    v, n = np.array(values, float), 0
    while True:
        k = v[abs(v - v.mean()) <= 2 * v.std()]
        if len(k) == len(v):
            break
        v, n = k, n + 1
    assert (r["n"], r["passes"]) == (len(v), n) and r["value"] == pytest.approx(v.mean())


def test_minmax_rejects_one_of_ties(spark):
    assert one(stacking.minmax_reject_stack(px(spark, [5, 5, 5, 5])))["n"] == 2
    assert stacking.minmax_reject_stack(px(spark, [5, 6])).count() == 0


def test_identical_frames_stack_to_themselves(spark, sf_dir):
    p = frames.embedding_pixels(spark, sf_dir).where("frame_id = 0")
    many = p.unionByName(p.withColumn("frame_id", F.lit(1).cast("long"))).unionByName(p.withColumn("frame_id", F.lit(2).cast("long")))
    want = {(r.x, r.y): r.v for r in p.collect()}
    for r in stacking.sigma_clip_stack(many).collect():
        assert r.value == pytest.approx(want[r.x, r.y])


def test_arrays_and_pixels_round_trip(spark):
    df = spark.createDataFrame([(1, 2, [0.5, 1.5, 2.5, 3.5])], "frame_id long, group_id int, data array<double>")
    assert frames.arrays(frames.pixels(df, 2), 2).collect() == df.collect()


def test_flat_of_zero_gives_null(spark):
    flat = spark.createDataFrame([(0, 0, 0.0)], "x int, y int, value double")
    assert one(calibration.divide_flat(px(spark, [3]), flat))["v"] is None


def test_nearest_by_scalar_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    left = [(i, int(t)) for i, t in enumerate(rng.integers(0, 50, 200))] + [(900, None)]
    right = [(i, int(t)) for i, t in enumerate(rng.integers(0, 50, 15))]
    got = calibration.nearest_by_scalar(spark.createDataFrame(left, "l long, t long"), spark.createDataFrame(right, "r long, t long"), "l", "r", "t", 8)
    want = {i: min((abs(t - u), j) for j, u in right)[::-1] for i, t in left if t is not None}
    assert {r.l: (r.r, r.distance) for r in got.collect()} == want


def test_segments_join_diagonally_and_name_the_first_cell(spark):
    cells = [[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 1]]
    got = {(r.x, r.y): r.source for r in detection.segments(image(spark, cells), 4, 4, 0.5).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (3, 0): 3, (3, 1): 3, (0, 3): 12, (3, 3): 15}


def test_plateau_has_no_maximum(spark):
    assert detection.local_maxima_2d(image(spark, [[2, 2], [0, 0]]), 1).count() == 0
    assert detection.local_maxima_2d(image(spark, [[2, 0], [0, 0]]), 1).count() == 1


def test_transform_is_recovered(spark):
    a, b, tx, ty = 0.9, 0.2, 3.0, -1.5
    rows = [(0, float(x), float(y), a * x - b * y + tx, b * x + a * y + ty) for x, y in [(0, 0), (1, 0), (0, 2), (5, 3)]]
    r = one(registration.similarity_transform(spark.createDataFrame(rows, "frame_id long, x double, y double, u double, v double")))
    assert [r[k] for k in ("a", "b", "tx", "ty")] == pytest.approx([a, b, tx, ty])


def test_integer_shift_and_kept_weight(spark):
    p = image(spark, [[1, 2], [3, 4]])
    t = spark.createDataFrame([(0, 1.0, 0.0, 1.0, 2.0)], "frame_id long, a double, b double, tx double, ty double")
    assert {(r.x, r.y): r.value for r in resample.bilinear_resample(p, t).collect()} == {(1, 2): 1, (2, 2): 2, (1, 3): 3, (2, 3): 4}
    t = spark.createDataFrame([(0, 1.0, 0.0, 0.3, 0.7)], "frame_id long, a double, b double, tx double, ty double")
    assert resample.bilinear_resample(p, t).agg(F.sum("coverage")).first()[0] == pytest.approx(4)


def test_session_gap_is_inclusive(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:01")]
    e = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.lit(1))
    assert sorted(r.n for r in timeline.capture_sessions(e, "user_id").collect()) == [1, 2]


@pytest.mark.parametrize("f", [stacking.basic_stack, stacking.sigma_clip_stack, stacking.sigma_clip_converged, stacking.weighted_stack, stacking.selected_stack, stacking.mad_clip_stack, stacking.winsorised_stack])
def test_empty_tables(spark, f):
    assert f(px(spark, [1]).limit(0)).count() == 0


def test_sessions_and_matches_cross_midnight(spark):
    rows = [(1, 1, "2024-01-01 23:55:00", "click", 1), (2, 1, "2024-01-02 00:05:00", "purchase", 2), (3, 1, "2024-01-02 00:20:00", "purchase", 3), (4, None, "2024-01-02 00:00:00", "purchase", 4), (5, 1, "2024-01-05 00:00:00", "click", 5), (6, 1, "2024-01-07 00:00:00", "purchase", 6), (7, 1, None, "click", 7)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value long").withColumn("ts", F.col("ts").cast("timestamp"))
    s = {(r.user_id, r.n, r.total) for r in timeline.capture_sessions(e, "user_id").collect()}
    assert s == {(1, 2, 3), (1, 1, 3), (None, 1, 4), (1, 1, 5), (1, 1, 6)}
    m = timeline.as_of(e, "user_id", F.col("event_type") == "click", F.col("event_type") == "purchase")
    assert {r.event_id: r.match and r.match.event_id for r in m.collect()} == {2: 1, 3: 1, 4: None, 6: 5}


def clipped(values):
    """(value, n, passes) of a plain loop."""
    v, passes = np.array(values), 0
    while True:
        kept = v[abs(v - v.mean()) <= 2 * (1 + 1e-15) * v.std()]
        if len(kept) in (0, len(v)):
            return pytest.approx(v.mean()), len(v), passes
        v, passes = kept, passes + 1


def test_windows_hold_no_cell_of_many_frames(spark, monkeypatch):
    """A window for each pass would hold a copy of the cell, 32 in a round: cells beyond a window's buffer of 4096 rows go without."""
    cells = {x: np.random.default_rng(x).laplace(size=n) for x, n in enumerate([9000, 4000, 50])}
    px = spark.createDataFrame(pd.DataFrame([(f, 0, x, 0, v) for x, vs in cells.items() for f, v in enumerate(vs)], columns=["frame_id", "group_id", "x", "y", "v"]))
    fullest = []

    def spied(df, name, paths=None):
        out = shared.written(df, name, paths)
        if "Window [" in df._jdf.queryExecution().optimizedPlan().toString():
            fullest.append(out.groupBy("group_id", "x", "y").count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(stacking, "written", spied)
    assert {r.x: (r.value, r.n, r.passes) for r in stacking.sigma_clip_converged(px).collect()} == {x: clipped(v) for x, v in cells.items()}
    assert 0 < max(fullest) <= 4096


@pytest.mark.parametrize("crowded", [0, 3, 40])
def test_crowded_cells_clip_like_others(spark, monkeypatch, crowded):
    """By ranges and by windows the same: cells of all sizes, null keys, equal and infinite values, cells that a pass would empty."""
    rng = np.random.default_rng(11)
    cells = {x: rng.normal(size=n) * rng.choice([1, 1, 30], size=n) for x, n in enumerate([1, 2, 3, 4, 5, 39, 40, 41, 300])}
    cells |= {20: [0.1] * 3, 21: [0.1] * 50, 22: [0.0, -0.0] * 30 + [5.0], 23: [1.0, 2.0, float("inf")], 24: [0, 0, 0, 0, 1.0], None: [*rng.normal(size=60), 99.0]}
    rows = [(i, None if x is None else 0, x, 0, float(v)) for x, vs in cells.items() for i, v in enumerate(vs)]
    px = spark.createDataFrame([*rows, (1, 0, 50, 0, None), (1, 0, 1, 0, float("nan"))], "frame_id long, group_id int, x int, y int, v double")
    monkeypatch.setattr(stacking, "CROWDED", 10**9)
    want = {r.x: (r.group_id, r.y, pytest.approx(r.value, nan_ok=True), r.n, r.passes) for r in stacking.sigma_clip_converged(px).collect()}
    assert len(want) == len(cells) and want[None][3] < 61
    monkeypatch.setattr(stacking, "CROWDED", crowded)
    if crowded == 3:
        monkeypatch.setattr(stacking, "BROADCAST", 0)
    got = stacking.sigma_clip_converged(px).collect()
    assert len(got) == len(want) and {r.x: (r.group_id, r.y, r.value, r.n, r.passes) for r in got} == want
