"""Drizzle against a clipper of polygons, flux kept, and the bilinear resampling as its special case."""

import math
import random
from collections import defaultdict

import pytest

from plumeria.operators import resample


def clipped(polygon, x0, y0, x1, y1):
    """The polygon inside a box, by one half plane after another."""
    for axis, at, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(polygon, polygon[1:] + polygon[:1]):
            da, db = sign * (a[axis] - at), sign * (b[axis] - at)
            if da >= 0:
                out.append(a)
            if (da > 0) != (db > 0) and da != db:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        polygon = out
    return polygon


def area(polygon):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))) / 2


def plain(px, transforms, pixfrac, scale):
    cells = defaultdict(lambda: [0.0, 0.0])
    for f, g, x, y, v in px:
        if f not in transforms or v is None or math.isnan(v):
            continue
        a, b, tx, ty = (scale * c for c in transforms[f])
        h = pixfrac / 2
        drop = [(a * (x + h * dx) - b * (y + h * dy) + tx, b * (x + h * dx) + a * (y + h * dy) + ty) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        whole = area(drop)
        for i in range(math.floor(min(p[0] for p in drop)) - 1, math.ceil(max(p[0] for p in drop)) + 2):
            for j in range(math.floor(min(p[1] for p in drop)) - 1, math.ceil(max(p[1] for p in drop)) + 2):
                part = clipped(drop, i - 0.5, j - 0.5, i + 0.5, j + 0.5)
                share = area(part) / whole if len(part) > 2 else 0
                if share > 1e-12:
                    cells[g, i, j][0] += v * share
                    cells[g, i, j][1] += share
    return {k: (f / c, c, f) for k, (f, c) in cells.items()}


def frames(spark, px, transforms):
    return (
        spark.createDataFrame([(*p, "z") for p in px], "frame_id long, group_id int, x int, y int, v double, c string"),
        spark.createDataFrame([(f, *t, 0.5) for f, t in transforms.items()], "frame_id long, a double, b double, tx double, ty double, u double"),
    )


def result(df):
    return {(r.group_id, r.x, r.y): (r.value, r.coverage, r.flux) for r in df.collect()}


@pytest.mark.parametrize("pixfrac", [0.1, 0.5, 1.0])
@pytest.mark.parametrize("scale", [0.4, 1.0, 3.0])
def test_equals_a_clipper(spark, pixfrac, scale):
    r = random.Random(int(100 * pixfrac + scale))
    angles = [0, math.pi / 2, math.pi, math.pi / 4, 1e-9, 1e-5, *(r.uniform(-4, 4) for _ in range(6))]
    transforms = {f: (k * math.cos(t), k * math.sin(t), r.choice([0.0, 0.5, 0.25, r.uniform(-9, 9)]), r.choice([0.0, -0.5, r.uniform(-9, 9)])) for f, (t, k) in enumerate((t, r.choice([1.0, 0.5, 1.7])) for t in angles)}
    px = [(f, f % 2, x, y, r.choice([None, math.nan, 0.0, r.gauss(0, 3), r.gauss(5, 1)])) for f in range(14) for x in range(-2, 3) for y in range(3)]
    px += px[:9]
    got, want = result(resample.drizzle(*frames(spark, px, transforms), pixfrac, scale)), plain(px, transforms, pixfrac, scale)
    assert set(got) == set(want)
    for k, (value, coverage, flux) in want.items():
        assert got[k][1] == pytest.approx(coverage, abs=1e-11) and got[k][2] == pytest.approx(flux, abs=1e-10)
        if coverage > 1e-6:
            assert got[k][0] == pytest.approx(value, rel=1e-6, abs=1e-6)
    kept = [v for f, _, _, _, v in px if f in transforms and v is not None and not math.isnan(v)]
    assert sum(f for _, _, f in got.values()) == pytest.approx(sum(kept), abs=1e-8)
    assert sum(c for _, c, _ in got.values()) == pytest.approx(len(kept), abs=1e-8)


def test_whole_pixels_without_rotation_are_bilinear(spark):
    r = random.Random(4)
    px = [(f, 0, x, y, r.gauss(0, 1)) for f in range(5) for x in range(6) for y in range(6)]
    d = frames(spark, px, {f: (1.0, 0.0, r.uniform(-3, 3), f / 2) for f in range(5)})
    got, want = result(resample.drizzle(*d)), {(x.group_id, x.x, x.y): (x.value, x.coverage) for x in resample.bilinear_resample(*d).collect()}
    assert set(got) == set(want) and all(got[k][:2] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_odd_rows(spark):
    px, t = frames(spark, [(1, None, 0, 0, 2.0), (2, 1, 0, 0, 1.0), (3, 1, None, 0, 1.0), (4, 1, 5, 5, 7.0)], {1: (1.0, 0.0, 0.0, 0.0), 2: (0.0, 0.0, 1.0, 1.0), 3: (1.0, 0.0, 0.0, 0.0), 4: (1.0, None, 0.0, 0.0)})
    assert result(resample.drizzle(px, t, 0.5)) == {(None, 0, 0): (2.0, 1.0, 2.0)}
    assert resample.drizzle(px.limit(0), t).count() == 0 and resample.drizzle(px, t.limit(0)).count() == 0
    for bad in ((0, 1), (1.5, 1), (1, 0)):
        with pytest.raises(ValueError):
            resample.drizzle(px, t, *bad)


def test_a_hot_frame_is_combined_before_the_shuffle(spark):
    px, t = frames(spark, [(1, 0, 0, 0, 1.0)], {1: (1.0, 0.0, 0.0, 0.0)})
    plan = resample.drizzle(px, t)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
