"""Frames in time: capture sessions and as-of matches.

Both cut a key's rows by time first, so that a key with most of the rows is spread over its days;
what then meets for each key is a row or two for each day. Null keys are a key of their own, NaN and null
values add nothing, repeated rows count each time, and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.columns import clean, fresh


def capture_sessions(events: DataFrame, key: str, gap: str = "10 minutes", value: str = "value", cut: str = "day") -> DataFrame:
    """(key, started, ended, n, total): rows of a key no more than the gap apart. ended is the last row's time.

    Sessions are found inside each ``cut`` of time and then joined where two follow within the gap.
    Rows without a time belong to no session.
    """
    parts = (
        events.where("ts is not null")
        .groupBy(key, F.date_trunc(cut, "ts").alias("_cut"), F.session_window("ts", gap).alias("_w"))
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.sum(clean(value)).alias("total"))
    )
    of_key = Window.partitionBy(key).orderBy("started")
    apart = F.coalesce(F.col("started") > F.lag("ended").over(of_key) + F.expr(f"interval {gap}"), F.lit(True))
    parts = parts.withColumn("_new", apart.cast("int")).withColumn("_k", F.sum("_new").over(of_key))
    joined = parts.groupBy(key, "_k").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return joined.drop("_k")


def as_of(events: DataFrame, key: str, wanted: Column, asking: Column, order: tuple[str, ...] = ("ts", "event_id"), cut: str = "day", name: str = "match") -> DataFrame:
    """Asking rows with all columns and ``name``: (order columns, value) of the latest earlier wanted row of the key, or null.

    A column of that name is replaced. The first of the order columns is a time. Inside each ``cut`` of it a
    window finds the match; where a cut has none so far, it is the latest of the cuts before. Rows without a
    time come first.
    """
    found = F.struct(*order, "value")
    names = [fresh(events.columns, c) for c in ("cut", "wanted", "inside", "cut_key", "cut_of", "before")]
    day, is_wanted, within, cut_key, cut_of, earlier = names
    rows = events.withColumn(day, F.date_trunc(cut, order[0])).withColumn(is_wanted, wanted)
    cuts = rows.groupBy(F.col(key).alias(cut_key), F.col(day).alias(cut_of)).agg(F.max(F.when(F.col(is_wanted), found)).alias("latest"))
    before = Window.partitionBy(cut_key).orderBy(F.col(cut_of).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(cut_key, cut_of, F.last("latest", ignorenulls=True).over(before).alias(earlier))
    inside = Window.partitionBy(key, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(within, F.last(F.when(F.col(is_wanted), found), ignorenulls=True).over(inside)).where(asking)
    rows = rows.join(cuts, F.col(key).eqNullSafe(F.col(cut_key)) & F.col(day).eqNullSafe(F.col(cut_of)))
    kept = [c for c in events.columns if c.lower() != name.lower()]
    return rows.select(*kept, F.coalesce(within, earlier).alias(name))
