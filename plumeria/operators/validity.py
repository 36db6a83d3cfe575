"""Exposures matched with the ranges of time in which masters are valid.

A range is filed under cells of time at one level: the cell's width is a power of 4 microseconds, between a quarter of the range's length
and that length, so that it meets at most five cells. A time is looked up once at each level that some range uses (at most 32). So the match is an equi-join on
(level, cell) followed by the exact comparison (the cells of a range are at most three times its length); no
range predicate is planned as a nested loop, and one range over all time costs a handful of rows.

Scale: ranges are broadcast up to ``BROADCAST`` filed rows, else both sides are shuffled by (level, cell), where
Spark splits cells that hold much. Ranges are held to the span of the times first.

A range is half-open: from its start on, before its end. A null start or end is open. Ranges that are empty or end before they start match nothing, and
neither do null times and null keys. Repeated rows on either side each match; empty tables give no rows; all columns of the
exposures are kept, and a column of the match's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.columns import fresh

#: Filed rows of ranges (up to five for each) that are broadcast.
BROADCAST = 1_000_000


def _level(length: Column) -> Column:
    """The largest power of 4 that is at most the length, as its exponent: 0, 1, 2, ..."""
    return F.floor((F.length(F.bin(length)) - 1) / 2).cast("int")


def _cell(t: Column, level: Column) -> Column:
    return F.call_function("shiftright", t, level * 2)


def valid_at(exposures: DataFrame, ranges: DataFrame, at: str = "ts", start: str = "valid_from", end: str = "valid_to", on: tuple[str, ...] = (), name: str = "match") -> DataFrame:
    """Exposures with ``name``, a range as a struct of its columns: a row for each range that holds the exposure's time and has equal ``on`` columns.

    Times are timestamps.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t, level, cell, lo, hi, row = (fresh([*exposures.columns, name, *(f"_{c}" for c in on)], c) for c in ("time", "level", "cell", "lo", "hi", "range_row"))
    keys = [fresh([*exposures.columns, name], f"range_{c}") for c in on]
    times = exposures.drop(*(c for c in exposures.columns if c.lower() == name.lower())).withColumn(t, micros(at)).where(F.col(t).isNotNull())
    first, last = times.agg(F.min(t), F.max(t)).first()
    first, last = (0, -1) if first is None else (first, last)
    filed = ranges.select(
        F.struct("*").alias(row), *(F.col(c).alias(k) for c, k in zip(on, keys)),
        F.greatest(F.coalesce(micros(start), F.lit(first)), F.lit(first)).alias(lo), F.least(F.coalesce(micros(end), F.lit(last + 1)), F.lit(last + 1)).alias(hi),
    ).where(F.col(lo) < F.col(hi))
    filed = filed.withColumn(level, _level(F.col(hi) - F.col(lo)))
    used = sorted(r[0] for r in filed.select(level).distinct().collect())  # at most 32
    filed = filed.withColumn(cell, F.explode(F.sequence(_cell(F.col(lo), F.col(level)), _cell(F.col(hi) - 1, F.col(level)))))
    small = F.broadcast if filed.count() <= BROADCAST else lambda df: df
    looks = F.array(*(F.struct(F.lit(k).alias(level), _cell(F.col(t), F.lit(k)).alias(cell)) for k in used)).cast(f"array<struct<{level}:int,{cell}:bigint>>")
    asked = times.select("*", F.inline(looks))
    same = [F.col(c) == F.col(k) for c, k in zip(on, keys)]
    # the names on the two sides are the same, so the filed ones get names of their own
    there = filed.withColumnsRenamed({level: f"_{level}", cell: f"_{cell}"})
    meet = [F.col(level) == F.col(f"_{level}"), F.col(cell) == F.col(f"_{cell}"), *same, F.col(t) >= F.col(lo), F.col(t) < F.col(hi)]
    found = asked.join(small(there), meet)
    return found.select(*times.drop(t).columns, F.col(row).alias(name))
