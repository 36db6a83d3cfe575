"""The global solution against planted zero points and a dense least-squares solver."""

import math
import random

import numpy as np
import pytest

from plumeria.operators import photometry


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "c") for r in rows], "frame_id long, star_id long, m double, weight double, n int, component string").repartition(4)


def solved(spark, rows, **more):
    frames, stars = photometry.zero_points(table(spark, rows), **more)
    return {r.frame_id: r for r in frames.collect()}, {r.star_id: r for r in stars.collect()}


def planted(seed, n_frames, n_stars, each, noise=0.0):
    r = random.Random(seed)
    z, s = [r.gauss(0, 1) for _ in range(n_frames)], [r.uniform(5, 20) for _ in range(n_stars)]
    rows = [(f, k, z[f] + s[k] + r.gauss(0, noise), r.choice([1.0, 4.0, 0.25])) for f in range(n_frames) for k in {0, *r.sample(range(n_stars), each)}]
    return z, s, rows


def test_planted_zero_points(spark):
    z, s, rows = planted(1, 60, 300, 12)
    frames, stars = solved(spark, rows, weight="weight")
    level = sum(z) / len(z)
    assert all(abs(frames[f].zero_point - (v - level)) < 1e-6 and frames[f].component == 0 for f, v in enumerate(z))
    assert all(abs(r.magnitude - (s[k] + level)) < 1e-6 for k, r in stars.items()) and len(stars) == len({r[1] for r in rows})
    assert frames[3].n == sum(r[0] == 3 for r in rows) and stars[0].n == 60


def test_equals_dense_least_squares(spark, monkeypatch):
    monkeypatch.setattr(photometry, "BROADCAST", 0)  # by shuffles
    _, _, rows = planted(2, 25, 40, 4, noise=0.5)
    rows += rows[:30] + [(1, 2, math.nan, 1.0), (1, 3, None, 1.0), (None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 1, 5.0, 0.0), (1, 1, 5.0, None), (1, 1, 5.0, -2.0)]
    frames, stars = solved(spark, rows, weight="weight")
    good = [r for r in rows if None not in r and not math.isnan(r[2]) and r[3] > 0]
    a = np.zeros((len(good) + 1, 65))
    for i, (f, k, m, w) in enumerate(good):
        a[i, f] = a[i, 25 + k] = math.sqrt(w)
    a[-1, :25] = 1
    x = np.linalg.lstsq(a, np.array([m * math.sqrt(w) for _, _, m, w in good] + [0.0]), rcond=None)[0]
    assert np.allclose([frames[f].zero_point for f in range(25)], x[:25], atol=1e-6)
    assert all(abs(r.magnitude - x[25 + k]) < 1e-6 for k, r in stars.items())


def test_components_have_levels_of_their_own(spark):
    rows = [(1, 10, 5.0, 1.0), (2, 10, 7.0, 1.0), (2, 11, 1.0, 1.0), (3, 11, 2.0, 1.0), (7, 20, 3.0, 1.0), (8, 20, 3.5, 1.0), (9, 30, 4.0, 1.0)]
    frames, stars = solved(spark, rows)
    assert {f: r.component for f, r in frames.items()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    assert [round(frames[f].zero_point, 9) for f in (1, 2, 3)] == [-5 / 3, 1 / 3, 4 / 3] or np.allclose([frames[f].zero_point for f in (1, 2, 3)], [-5 / 3, 1 / 3, 4 / 3])
    assert abs(frames[7].zero_point + 0.25) < 1e-9 and frames[9].zero_point == 0 and stars[30].magnitude == 4 and stars[20].component == 7


def test_a_chain_of_frames_takes_many_rounds(spark):
    """Each frame shares a star with the next only; too few rounds are an error, not a wrong answer."""
    rows = [(f, f + d, float(f % 5) + (f + d), 1.0) for f in range(12) for d in (0, 1)]
    frames, _ = solved(spark, rows)
    level = sum(f % 5 for f in range(12)) / 12
    assert all(abs(frames[f].zero_point - (f % 5 - level)) < 1e-6 for f in range(12))
    with pytest.raises(RuntimeError, match="rounds"):
        photometry.zero_points(table(spark, rows), rounds=2)


def test_empty(spark):
    frames, stars = photometry.zero_points(table(spark, [(1, 1, 1.0, 1.0)]).limit(0))
    assert frames.count() == 0 and stars.count() == 0 and frames.columns == ["frame_id", "component", "zero_point", "n"]
