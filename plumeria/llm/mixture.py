"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. The sources, in code point order (null last), have the weights
5, 2, 1, 5, ... and share all words of the corpus by weight; a target stops at ``most`` times its source's words, and what is
over is shared again by weight among the others until no target is above (a level is raised until the sets settle).

Every document of a source is taken as often as its target holds the source whole. The rest of the target, the budget, is below the source's
words and is met by taking some documents once more. Documents are counted by their exact length: going up the lengths, each gives its share of the budget in whole
documents and hands the words that are left to the next, so the mix keeps the source's lengths and less than the longest
document is left at the end. That remaining budget is a bounded knapsack: a dynamic program over the reachable sums (a
bit for each) with the documents not yet taken finds the sum nearest to it, short of it or over. Of each length as many documents as the
fit counts are then selected, in the order of a seeded hash of id and text.

Scale: texts are read once for (id, source, size, hash). Equal rows are counted before they are shuffled. A source's fit gets a row for
each distinct length, whatever the number of documents. The selection inside (source, length) deals the documents to buckets by their hash,
about ``BUCKET`` in each; counts of the buckets tell where the cut falls and a window ranks inside a bucket, so a length that
a third of all documents have is spread. The sources are ranked by ranges; their number is not bounded.

Nulls: a null text has no words; a null source is a source of its own, the last; null ids are ids like others. Documents without words are
taken as 0 words. Repeated rows keep a row each; if the cut falls among them, some of them are taken once more. Without words in any document all
targets are 0; an empty table gives no rows. Other columns play no part. Equal tables give equal mixes, however they are partitioned.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import WORD, saved, ship

WEIGHTS = (5, 2, 1)
#: Times that a document, and a source as a whole, is taken at most.
MOST = 3
SEED = 12
#: Documents of a bucket, about; equal rows that one task gives back.
BUCKET, TOGETHER = 256, 4096


def rows_of(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key, copies): equal rows once. Sources are written so that their order is that of code points, null last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("source")
    size, key = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key")
    return docs.select(F.col(id_col).alias("doc_id"), source, size, key).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies"))


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with the weight of its place among the sources. Written."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = saved(sizes.repartitionByRange(n, "source").withColumn("range", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("source")) - 1
    weight = F.array(*map(F.lit, weights))[(place % len(weights)).cast("int")].cast("long")
    return saved(ranges.join(F.broadcast(starts), "range").select("source", "source_size", weight.alias("weight")), "weights")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target: the share by weight of all words, at most ``most`` times the source's own."""
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (free or 1), -1
    while total:
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        n, held, free = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped:
            break
        level, capped = (total - held) / free, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double")))


def nearest_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, at most its count, add up nearest to the budget (of two equally near sums the smaller)."""
    most = 2 * budget  # more than that is farther than nothing
    every, reach, steps = (1 << (most + 1)) - 1, 1, []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        left, times = min(counts[k], most // lengths[k]), 1
        while left > 0 and not reach >> budget & 1:
            taken = min(times, left)
            steps.append((reach, k, taken))
            reach |= reach << (taken * lengths[k]) & every
            left, times = left - taken, 2 * times
    below = (reach & ((2 << budget) - 1)).bit_length() - 1
    over = reach >> (budget + 1)
    above = budget + (over & -over).bit_length() if over else None
    at, out = above if above is not None and above - budget < budget - below else below, [0] * len(lengths)
    for before, k, taken in reversed(steps):
        if not before >> at & 1:
            at -= taken * lengths[k]
            out[k] += taken
    return out


def fit_counts(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length (rising, above 0) are taken once more, so that their words come to the budget."""
    total = sum(n * c for n, c in zip(lengths, counts))
    out, upto, taken = [], 0, 0
    for n, c in zip(lengths, counts):
        upto += n * c
        out.append(min(c, (budget * upto // total - taken) // n))
        taken += out[-1] * n
    rest = nearest_sum(lengths, [c - k for c, k in zip(counts, out)], budget - taken)
    return [a + b for a, b in zip(out, rest)]


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    some = rows["size"] > 0
    rows["more"] = 0
    if some.any():
        rows.loc[some, "more"] = fit_counts(rows["size"][some].tolist(), rows["n"][some].tolist(), int(rows["budget"][0]))
    return rows[["source", "size", "more", "n", "distinct", "whole", "source_size", "target"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of each row: it is taken ``times`` times, which gives ``taken`` words."""
    ship(docs.sparkSession)
    rows = saved(rows_of(docs, seed, id_col, text_col, source_col), "rows")
    counted = saved(rows.groupBy("source", "size").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct")), "lengths")
    sources = with_targets(source_weights(saved(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "totals"), weights), most)
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    whole = F.least(whole, F.lit(most)).cast("long").alias("whole")
    sources = sources.select("source", "source_size", "target", words.alias("words"), whole)
    sources = sources.withColumn("budget", F.col("words") - F.col("whole") * F.col("source_size")).drop("words")
    kinds = "source string, size long, more long, n long, distinct long, whole long, source_size long, target double"
    fitted = saved(counted.join(sources, "source").groupBy("source").applyInPandas(_fit, kinds), "fitted")
    dealt = rows.join(fitted, ["source", "size"]).withColumn("bucket", F.pmod(F.col("key"), F.ceil(F.col("distinct") / BUCKET)))
    dealt = saved(dealt, "dealt")
    by = Window.partitionBy("source", "size")
    upto = F.coalesce(F.sum("c").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = dealt.where("more > 0 AND more < n").groupBy("source", "size", "bucket").agg(F.sum("copies").alias("c")).select("source", "size", "bucket", upto.alias("before"))
    inside = Window.partitionBy("source", "size", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = dealt.where("more > 0 AND more < n").join(buckets, ["source", "size", "bucket"])
    cut = cut.withColumn("more", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("more") - F.col("before") - F.sum("copies").over(inside) + F.col("copies")))).drop("before")
    plain = dealt.where("more = 0 OR more = n").withColumn("more", F.when(F.col("more") > 0, F.col("copies")).otherwise(0))
    done = _given_back(cut.unionByName(plain))
    source = F.when(F.substring("source", 1, 1) == "0", F.expr("substring(source, 2)")).cast(docs.schema[source_col].dataType).alias("source")
    return done.select("doc_id", source, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def _given_back(rows: DataFrame) -> DataFrame:
    """A row for each copy; ``more`` of them are taken once more. Rows with many copies are dealt out in runs first."""
    runs = F.expr(f"explode(sequence(1L, copies, {TOGETHER}L))").alias("first")
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "more", "copies"]
    few = rows.where(F.col("copies") <= TOGETHER).select(*columns, F.lit(1).cast("long").alias("first"))
    many = rows.where(F.col("copies") > TOGETHER).select(*columns, runs)
    many = many.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copy = F.expr(f"explode(sequence(first, least(first + {TOGETHER - 1}L, copies)))").alias("copy")
    return few.unionByName(many).select(*columns, copy).withColumn("times", F.col("whole") + (F.col("copy") <= F.col("more")).cast("long"))
