"""Contiguous shards of near-equal bytes from global prefix sums [native].

The rows are put in the order of (id, checksum, size). The partitions of that order (ranges, dealt
out by a sample) give per-partition totals; their running sum is the byte offset at which each
range starts, and a window inside each range adds what comes before a row. A row
whose first byte lies at offset ``o`` of ``total`` goes to shard ``o * n_shards div total``, so
shards are contiguous in the order and differ from the target by less than one row at each cut.

Only (id, size, checksum) is shuffled, never the text, and no group of equal texts or of one
source comes together: the order is by id, and rows that tie in all three are parted by where they
were read. The totals have one row per range and the shard
starts one row per shard, so both are broadcast whatever the size of the input.

Nulls: a null text counts no bytes (size is the overhead alone, checksum 0); a null id sorts
first. Repeated rows tie and keep one place each. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import saved


def row_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32) of each row; the only pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def byte_shards(sizes: DataFrame, n_shards: int, buckets: int | None = None) -> DataFrame:
    """Adds shard and slot to rows of :func:`row_sizes`. ``buckets``: ranges for the prefix sums."""
    spark = sizes.sparkSession
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the sizes are written before they are dealt out, since that samples them; then with their range, which must not change
    ranges = saved(sizes, "sizes").withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "text_crc32", "size", "place")
    rows = saved(ranges.drop("place").withColumn("bucket", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        F.sum("b").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.join(F.broadcast(offsets), "bucket").select(
        "doc_id",
        "size",
        "text_crc32",
        "total",
        (F.col("b0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"),
        (F.col("c0") + F.row_number().over(inside) - 1).alias("rank"),
    )
    placed = ranked.withColumn("shard", F.expr(f"cast(`offset` * {n_shards} div total as int)"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "offset"
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return byte_shards(row_sizes(docs, id_col, text_col), n_shards)
