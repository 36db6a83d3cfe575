"""The same aggregates over frames that arrive: Structured Streaming.

Files are read in order of their modification time, one for each batch. Rows later than the watermark
are dropped by Spark, so results equal those over the whole table where files arrive in time order, or
out of it by less than the watermark's patience. Windows and sessions are given out once they can't
change any more (append mode), running aggregates after every batch (complete mode). Null and NaN
values add nothing; rows without a time belong to no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.functions.columns import clean
from plumeria.functions.shared import new_path, until_exit

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def arriving(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a table (a file or a folder of files), in order of their time; ``ts`` as a timestamp."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # a stream reads folders only
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        stream = reader.parquet(f"{folder}/{name}.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def running_stack(events: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    v = clean(value)
    return events.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"))


def window_stack(events: DataFrame, keys: list[str], width: str = "1 hour", late: str = "1 hour", value: str = "value") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(clean(value)).alias("total")).select(F.col("w.start").alias("started"), *keys, "n", "total")


def session_stack(events: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 hour", value: str = "value") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum(clean(value)).alias("total")).select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), key, "n", "total")


def calibrated(exposures: DataFrame, masters: DataFrame, key: str, before: str = "30 minutes", after: str = "10 minutes", late: str = "1 hour", master: str = "event_id", bucket: str = "1 hour") -> DataFrame:
    """Exposures as they come, with each master of their key taken from ``before`` them to ``after`` them (``master_id``, ``master_ts``): a row for each, or one with nulls.

    Both are streams with ``ts``. A match comes out as soon as both are there, in whatever order they arrived; an exposure without one when the watermarks of both streams
    show that none can come any more. Rows later than the watermark are dropped, and so are rows without a time. A null key matches nothing.
    State is kept by key and ``bucket`` of time (a master under each bucket whose exposures it may match), so a hot key is spread over its hours.
    """
    seconds = lambda c: F.col(c).cast("double")
    of = F.expr(f"cast(interval {bucket} as interval second)").cast("decimal(20,6)").cast("double")
    ahead, behind = (F.expr(f"cast(interval {x} as interval second)").cast("decimal(20,6)").cast("double") for x in (before, after))
    place = lambda t: F.floor(t / of)
    left = exposures.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("_bucket", place(seconds("ts")))
    right = masters.select(F.col(key).alias("_key"), F.col(master).alias("master_id"), F.col("ts").alias("master_ts")).where("master_ts IS NOT NULL").withWatermark("master_ts", late)
    right = right.withColumn("_of", F.explode(F.sequence(place(seconds("master_ts") - behind), place(seconds("master_ts") + ahead))))
    near = F.expr(f"master_ts >= ts - interval {before} AND master_ts <= ts + interval {after}")
    met = left.join(right, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")) & near, "left_outer")
    return met.drop("_bucket", "_of", "_key")


def clipped_stack(events: DataFrame, keys: list[str], width: str = "1 hour", late: str = "1 hour", value: str = "value", k: float = 2.0, passes: int = 2, revised: bool = False) -> DataFrame:
    """(keys, started, n, kept, mean, final) of each window: the mean of what ``passes`` sigma clips leave, as :func:`plumeria.operators.stacking.sigma_clip`.

    A clip can't be kept as a sum: a frame that comes late moves mean and deviation, and values that were clipped may come back. So the state of
    a key and window holds its values, and a timer at the window's end gives the result and clears it when the watermark passes. With ``revised`` (update mode) every batch
    also gives the result so far of the windows that it touches. Rows that arrive out of order within the patience count; later ones are dropped, as are null and NaN values and
    rows without a time. State is by key and window, so a hot key is spread over its windows; one window of one key is held at a time.
    Needs a state store with timers (``timers`` of :func:`drained`).
    """
    from plumeria.streaming.state import ClippedStack

    started = F.window("ts", width)["start"].alias("started")
    rows = events.where("ts IS NOT NULL").withWatermark("ts", late).where(clean(value).isNotNull()).select("ts", *keys, started, F.col(value).cast("double").alias("v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, "started").schema)
    seconds = events.sparkSession.sql(f"SELECT cast(cast(interval {width} as interval second) as decimal(20,6))").first()[0]
    return rows.groupBy(*keys, "started").transformWithStateInPandas(
        ClippedStack(len(keys), int(seconds * 1000), k, passes, revised), f"{kinds}, n long, kept long, mean double, final boolean", "update" if revised else "append", "eventtime"
    )


def drained(stream: DataFrame, name: str, mode: str = "append", places: tuple[str, str] | None = None, timers: bool = False) -> DataFrame:
    """Runs the stream over all that has arrived and gives its result as a table.

    append and update: files in the shared folder; complete: the last batch, overwritten there after each one. ``places``: folders of the
    result and of the checkpoint, where a run goes on that was stopped; new ones without it. ``timers``: with a state store that has them.
    """
    spark = stream.sparkSession
    out, log = places or (new_path(spark, name), new_path(spark, f"{name}-log"))
    store = spark.conf.get(STATE_STORE)
    if timers:  # read when the query starts
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "update":  # a batch that runs again replaces its own folder
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    spark.conf.set(STATE_STORE, store)
    query.awaitTermination()
    until_exit(spark, out)
    until_exit(spark, log)
    return spark.read.schema(stream.schema).parquet(out)
