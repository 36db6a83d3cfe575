"""The growing stack: batches against the whole, reruns, crashes, two writers, rank errors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumeria.operators.incremental import Conflict, IncrementalStack


def table(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], "group_id int, x int, y int, v double, sketch string").repartition(3)


def values(r, n):
    return [(r.choice([1, 2, None]), r.randint(0, 2), r.choice([0, 1, None]), r.choice([None, math.nan, *(r.gauss(1e6, 1) for _ in range(8))])) for _ in range(n)]


def found(stack, q=(0.5,)):
    return {(r.group_id, r.x, r.y): r for r in stack.result(q).collect()}


def test_batches_equal_the_whole(spark, tmp_path):
    r = random.Random(1)
    batches = [values(r, n) for n in (200, 1, 0, 300)]
    stack = IncrementalStack(spark, f"file://{tmp_path}/stack", k=4000)
    assert [stack.add(table(spark, b), "night", i) for i, b in enumerate(batches)] == [True] * 4
    want = {}
    for g, x, y, v in sum(batches, []):
        if v is not None and not math.isnan(v):
            want.setdefault((g, x, y), []).append(v)
    got = found(stack, (0.0, 0.25, 0.5, 1.0))
    assert set(got) == set(want)
    for cell, vs in want.items():
        vs.sort()
        mean = sum(vs) / len(vs)
        row = got[cell]
        assert (row.n, row.min, row.max) == (len(vs), vs[0], vs[-1]) and row["mean"] == pytest.approx(mean, rel=1e-14)
        assert row.stddev == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs)), abs=1e-7)
        assert row.q == [vs[max(0, math.ceil(q * len(vs)) - 1)] for q in (0, 0.25, 0.5, 1)]


def test_a_rerun_adds_nothing_twice(spark, tmp_path):
    stack = IncrementalStack(spark, f"file://{tmp_path}/stack")
    one = table(spark, [(1, 0, 0, 5.0), (1, 0, 0, 7.0)])
    assert stack.add(one, "a", 3) and not stack.add(one, "a", 3) and not stack.add(one, "a", 1)
    assert stack.add(one, "b", 0) and not IncrementalStack(spark, f"file://{tmp_path}/stack").add(one, "b", 0)
    assert found(stack)[1, 0, 0].n == 4 and found(stack)[1, 0, 0]["mean"] == 6.0


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    stack = IncrementalStack(spark, f"file://{tmp_path}/stack")
    one = table(spark, [(1, 0, 0, 5.0)])
    stack.add(one, "a", 0)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stack, "_commit", dies)
        with pytest.raises(OSError):
            stack.add(one, "a", 1)
    assert found(stack)[1, 0, 0].n == 1
    (tmp_path / "stack/manifests/000000000002").write_text('{"state": "sta')  # died while it wrote its manifest
    assert found(stack)[1, 0, 0].n == 1 and stack.add(one, "a", 1) and found(stack)[1, 0, 0].n == 2


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    a, b = (IncrementalStack(spark, f"file://{tmp_path}/stack") for _ in range(2))
    one = table(spark, [(1, 0, 0, 5.0)])
    seen = b._current()
    assert a.add(one, "a", 0)
    with monkeypatch.context() as m:
        m.setattr(b, "_current", lambda: seen)
        with pytest.raises(Conflict):
            b.add(one, "b", 0)
    assert b.add(one, "b", 0) and found(a)[1, 0, 0].n == 2


def test_rank_errors_stay_in_the_bound(spark, tmp_path):
    stack = IncrementalStack(spark, f"file://{tmp_path}/stack", k=200)
    n = 40_000
    px = spark.range(n).select(F.lit(1).alias("group_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"), "id")
    for k in range(4):
        stack.add(px.where(F.col("id") % 4 == k), "a", k)
    row = found(stack, (0.01, 0.25, 0.5, 0.75, 0.99))[1, 0, 0]
    assert row.n == n and all(abs(v / n - q) < 0.02 for v, q in zip(row.q, (0.01, 0.25, 0.5, 0.75, 0.99)))


def test_empty(spark, tmp_path):
    stack = IncrementalStack(spark, f"file://{tmp_path}/stack")
    assert stack.result().count() == 0 and stack.add(table(spark, [(1, 0, 0, None)]), "a", 0) and stack.result().count() == 0
