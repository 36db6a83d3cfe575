"""Ranges of validity against all pairs: open and empty ranges, instants, one range over all time."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from plumeria.operators import validity

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moment(us):
    return None if us is None else ZERO + timedelta(microseconds=us)


def tables(spark, times, ranges):
    t = spark.createDataFrame([(i, moment(u), k, 1, "x") for i, (u, k) in enumerate(times)], "id long, ts timestamp, camera string, match int, level string").repartition(3)
    r = spark.createDataFrame([(i, moment(a), moment(b), k, "y") for i, (a, b, k) in enumerate(ranges)], "id long, valid_from timestamp, valid_to timestamp, camera string, cell string")
    return t, r


def plain(times, ranges, on):
    return Counter((i, j) for i, (u, k) in enumerate(times) for j, (a, b, c) in enumerate(ranges) if u is not None and (a is None or a <= u) and (b is None or u < b) and (a is None or b is None or a < b) and (not on or k is not None and k == c))


@pytest.mark.parametrize("on", [(), ("camera",)])
@pytest.mark.parametrize("span", [50, 10**6, 10**13])
def test_equals_all_pairs(spark, monkeypatch, on, span):
    if span == 10**6:
        monkeypatch.setattr(validity, "BROADCAST", 0)
    r = random.Random(span)
    some = lambda: r.randint(-span, span)
    times = [(r.choice([some(), some(), 0, None]), r.choice(["a", "b", None])) for _ in range(150)]
    ranges = [(a, a + r.choice([0, 1, 2, 5, -3, r.randint(1, 2 * span), span // 100]), r.choice(["a", "b", None])) for a in (some() for _ in range(120))]
    ranges += [(None, None, "a"), (None, some(), "b"), (some(), None, "a"), (-4 * span, 4 * span, "b"), (5 * span, 6 * span, "a"), (0, 1, "a"), (0, 0, "a")]
    ranges += ranges[:5]
    t, f = tables(spark, times, ranges)
    out = validity.valid_at(t, f, on=on)
    assert out.columns == ["id", "ts", "camera", "level", "match"]
    assert Counter((x.id, x.match.id) for x in out.collect()) == plain(times, ranges, on)


def test_no_nested_loop_and_few_rows_for_a_range_over_all_time(spark, monkeypatch):
    monkeypatch.setattr(validity, "BROADCAST", 0)
    times = [(1000 * i, "a") for i in range(2000)]
    t, f = tables(spark, times, [(None, None, "a")] + [(1000 * i, 1000 * i + 1500, "a") for i in range(500)])
    out = validity.valid_at(t, f)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and out.count() == 2000 + 2 * 500
    assert validity.valid_at(t, f.limit(1)).count() == 2000


def test_empty(spark):
    t, f = tables(spark, [(1, "a"), (None, "a")], [(0, 5, "a")])
    assert validity.valid_at(t.limit(0), f).count() == 0 and validity.valid_at(t, f.limit(0)).count() == 0
    assert validity.valid_at(t.where("ts IS NULL"), f).count() == 0
    assert [x.match.id for x in validity.valid_at(t, f).collect()] == [0]
