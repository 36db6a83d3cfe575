"""Streams over files that arrive one by one, in and out of time order."""

import os
import time

from pyspark.sql import functions as F

from plumeria.sources import frames
from plumeria.streaming import live


def arrive(spark, tmp_path, parts):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        [made] = [f for f in os.listdir(tmp_path / f"part{i}") if f.endswith(".parquet")]
        os.rename(tmp_path / f"part{i}" / made, folder / f"p{i}.parquet")
        at = time.time() - 1000 + 10 * i
        os.utime(folder / f"p{i}.parquet", (at, at))
    return str(tmp_path)


def quarters(spark, sf_dir):
    e = frames.table(spark, sf_dir, "events").orderBy("ts").toPandas()
    n = len(e) // 4
    return [spark.createDataFrame(e.iloc[i * n : (i + 1) * n]) for i in range(4)]


def test_in_order_equals_the_batch(spark, sf_dir, tmp_path):
    parts = quarters(spark, sf_dir)
    folder = arrive(spark, tmp_path, parts)
    got = {(r.started, r.event_type): r.n for r in live.drained(live.window_stack(live.arriving(spark, folder, "events"), ["event_type"]), "w").collect()}
    batch = frames.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    want = {(r.w.start, r.event_type): r["count"] for r in batch.collect()}
    assert got.items() <= want.items() and len(got) > 0.9 * len(want)


def test_late_files_are_dropped_after_the_watermark(spark, sf_dir, tmp_path):
    folder = arrive(spark, tmp_path, quarters(spark, sf_dir)[::-1])
    out = live.drained(live.window_stack(live.arriving(spark, folder, "events"), ["event_type"]), "w")
    assert 0 < out.agg(F.sum("n")).first()[0] < frames.table(spark, folder, "events").count()


def test_running_stack_sees_all_batches(spark, sf_dir, tmp_path):
    folder = arrive(spark, tmp_path, quarters(spark, sf_dir))
    out = live.drained(live.running_stack(live.arriving(spark, folder, "events"), ["event_type"]), "r", "complete")
    assert out.agg(F.sum("n")).first()[0] == frames.table(spark, folder, "events").count()


def clipped(spark, folder, places=None, revised=False, late="1 hour"):
    stream = live.clipped_stack(live.arriving(spark, folder, "events"), ["event_type"], late=late, revised=revised)
    return live.drained(stream, "clipped", "update" if revised else "append", places, timers=True)


def batch_clipped(spark, folder):
    """The same over the whole table, with the clip of the frames."""
    from plumeria.operators import stacking

    e = frames.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    px = e.select(F.col("event_id").alias("frame_id"), F.struct("event_type", F.window("ts", "1 hour")["start"].alias("started")).alias("group_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("value").alias("v"))
    return {(r.group_id.event_type, r.group_id.started): (r.n, r.value) for r in stacking.sigma_clip_stack(px, 2.0, 2).collect()}


def same(got, want):
    return set(got) <= set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_clipped_stack_out_of_order_within_the_patience(spark, sf_dir, tmp_path):
    """Every other row of the six hours before a file's end comes with the next file; the run is stopped half way and goes on from its checkpoint."""
    e = frames.table(spark, sf_dir, "events").withColumn("value", F.expr("if(event_id % 97 = 0, NULL, if(event_id % 89 = 0, 'NaN'::double, value))"))
    n = e.count() // 4
    edges = [e.where(F.col("event_id") == F.lit(e.agg(F.min("event_id")).first()[0] + k * n)).first().ts for k in (1, 2, 3)]
    part, swapped = F.lit(0), F.lit(False)
    for edge in edges:
        soon = (F.col("ts") < F.lit(edge)) & (F.col("ts") >= F.lit(edge) - F.expr("interval 6 hours")) & (F.col("event_id") % 2 == 0)
        part, swapped = part + ((F.col("ts") >= F.lit(edge)) | soon).cast("int"), swapped | soon
    assert e.where(swapped).count() > 0
    files = [e.where(part == k) for k in range(4)]
    folder, places = arrive(spark, tmp_path, files[:2]), (str(tmp_path / "out"), str(tmp_path / "log"))
    half = clipped(spark, folder, places, late="8 hours").count()
    (tmp_path / "more").mkdir()
    more = arrive(spark, tmp_path / "more", files[2:])
    for k in (0, 1):
        os.rename(f"{more}/events.parquet/p{k}.parquet", f"{folder}/events.parquet/q{k}.parquet")
        os.utime(f"{folder}/events.parquet/q{k}.parquet", (time.time() - 500 + 10 * k,) * 2)
    out = clipped(spark, folder, places, late="8 hours").collect()
    got, want = {(r.event_type, r.started): (r.kept, r.mean) for r in out}, batch_clipped(spark, folder)
    assert all(r.final for r in out) and len(got) == len(out) > half > 0 and len(got) > 0.9 * len(want) and same(got, want)


def test_clipped_stack_is_revised_by_every_batch(spark, sf_dir, tmp_path):
    folder = arrive(spark, tmp_path, quarters(spark, sf_dir))
    out = clipped(spark, folder, revised=True).collect()
    last = {(r.event_type, r.started): (r.kept, r.mean) for r in sorted(out, key=lambda r: (r.batch, r.final))}
    want = batch_clipped(spark, folder)
    assert set(last) == set(want) and same(last, want) and any(r.final for r in out) and len(out) > len(want)


def joined(spark, folder, **more):
    e = lambda kind: live.arriving(spark, folder, "events").where(F.col("event_type") == kind)
    out = live.calibrated(e("purchase").select("event_id", "user_id", "ts"), e("click"), "user_id", **more)
    return sorted((r.event_id, r.master_id or -1) for r in live.drained(out, "calibrated").collect())


def test_arriving_masters(spark, sf_dir, tmp_path):
    """Every match of the batch comes out, whichever side was first, and unmatched exposures once the watermark has passed."""
    e = frames.table(spark, sf_dir, "events")
    n = e.count()
    e = e.withColumn("user_id", F.expr("if(event_id % 101 = 0, NULL, if(event_id % 3 = 0, 1, user_id))")).withColumn("ts", F.expr("if(event_id % 103 = 0, NULL, ts)"))
    folder = arrive(spark, tmp_path, [e.where(F.floor(F.col("event_id") * 4 / (n + 1)) == k) for k in range(5)])
    got = joined(spark, folder, bucket="20 minutes")
    spark.read.parquet(f"{folder}/events.parquet").createOrReplaceTempView("all_events")
    want = spark.sql("""SELECT f.event_id, m.event_id AS master_id, f.ts FROM (SELECT * FROM all_events WHERE event_type = 'purchase' AND ts IS NOT NULL) f LEFT JOIN (SELECT * FROM all_events WHERE event_type = 'click') m
        ON f.user_id = m.user_id AND m.ts >= f.ts - interval 30 minutes AND m.ts <= f.ts + interval 10 minutes""").collect()
    matches = {(r.event_id, r.master_id) for r in want if r.master_id is not None}
    assert matches and {x for x in got if x[1] >= 0} == matches and len(got) == len(set(got))
    free, alone = {x[0] for x in got if x[1] < 0}, {r.event_id: r.ts for r in want if r.master_id is None}
    open_still = set(alone) - free  # the last ones: a master may still come
    assert free < set(alone) and len(free) > 0.8 * len(alone) and max(alone[i] for i in free) < min(alone[i] for i in open_still)
