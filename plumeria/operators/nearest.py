"""The k nearest catalogue entries without a radius, and all within one.

The catalogue is packed into leaves of at most ``LEAF`` entries: ranges of (cx, cy), dealt out by a sample, become strips, and a
strip sorted by cy is cut every ``LEAF`` rows. So leaves follow the density, whatever the distribution, and a third
of all points in one spot gets a third of the leaves. Boxes around leaves are packed in the same way, ``FAN`` to a node, up to a root. Searching
entries are packed into blocks, smaller the fewer they are for the catalogue.

Blocks go down the tree together. At each level a block has some nodes with their counts and the least and greatest distance that
its entries can have to theirs; the greatest distances of the nearest nodes that hold k entries between them bound the
k-th neighbour, nodes beyond the bound go, and the others are replaced by their children (an equi-join on the
node). What is left are pairs of a block and a leaf; each gives the k best of the leaf for every entry of the block, and a window
picks among them. Rounding can't lose a neighbour, since it keeps the order of bounds and distances.

Scale: no key gathers more than a block, a leaf, or the nodes that bound a block. Entries at the same place are cut to the k of
smallest id first, since no other can be a neighbour. Node tables are broadcast up to ``BROADCAST`` rows.

Null, NaN and infinite coordinates are no places, and such rows are left out; ids may be null (they come first among equals) or repeated,
and every row of ``a`` has neighbours of its own. Empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.functions.shared import written

LEAF, FAN = 256, 16
BROADCAST = 200_000
#: Results of blocks and leaves that a worker gathers before it hands them on.
HELD = 1 << 16
FOUND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("d2", pa.float64())]))
BOX = ["x0", "x1", "y0", "y1"]


def _places(c: DataFrame) -> DataFrame:
    finite = lambda x: F.coalesce(F.abs(F.col(x).cast("double")) < float("inf"), F.lit(False))
    at = lambda x: (F.col(x).cast("double") + 0.0).alias(x)
    return c.where(finite("cx") & finite("cy")).select("id", at("cx"), at("cy"))


def packed(rows: DataFrame, x: str, y: str, last: str, size: int, n: int, name: str) -> DataFrame:
    """rows with the number of a group of at most ``size`` of them that lie together. Written."""
    strips = max(1, ceil(sqrt(n / size)))
    place = F.monotonically_increasing_id()  # partition and row: 33 bits
    group = F.shiftleft(F.shiftright("_place", 33), 33) + F.floor((F.col("_place") % (1 << 33)) / size)
    dealt = rows.repartitionByRange(strips, x, y, last).sortWithinPartitions(y, x, last)
    return written(dealt.withColumn("_place", place).withColumn(name, group).drop("_place"), name)


def _boxes(rows: DataFrame, name: str) -> DataFrame:
    side = lambda f, c, to: f(c).alias(to)
    return rows.groupBy(name).agg(side(F.min, "cx", "x0"), side(F.max, "cx", "x1"), side(F.min, "cy", "y0"), side(F.max, "cy", "y1"), F.count("*").alias("n"))


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves up: (node, parent, box, n); the last has at most FAN nodes and no parent."""
    level = written(leaves.withColumnRenamed("leaf", "node"), "leaves")
    levels = []
    while (n := level.count()) > FAN:
        middle = level.withColumns({"_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("y0") + F.col("y1")) / 2})
        level = packed(middle, "_x", "_y", "node", FAN, n, "parent").drop("_x", "_y")
        levels.append(level)
        level = written(level.groupBy(F.col("parent").alias("node")).agg(*(f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), BOX)), F.sum("n").alias("n")), "nodes")
    return [*levels, level]


def _bounded(pairs: DataFrame, k: int | None, d2: float | None) -> DataFrame:
    """Pairs of a block (box b_*) and a node (box) that can hold one of the k nearest of some entry of the block, or one within the squared distance."""
    c = F.col
    gap = lambda lo, hi: F.greatest(F.lit(0.0), c(lo) - c(f"b_{hi}"), c(f"b_{lo}") - c(hi))
    far = lambda lo, hi: F.greatest(c(hi) - c(f"b_{lo}"), c(f"b_{hi}") - c(lo))
    gx, gy, fx, fy = gap("x0", "x1"), gap("y0", "y1"), far("x0", "x1"), far("y0", "y1")
    pairs = pairs.withColumns({"_least": gx * gx + gy * gy, "_most": fx * fx + fy * fy})
    if k is None:
        return pairs.where(F.col("_least") <= d2).drop("_least", "_most")
    by = Window.partitionBy("block")
    upto = F.sum("n").over(by.orderBy("_most", "node").rowsBetween(Window.unboundedPreceding, 0))
    pairs = pairs.withColumn("_upto", upto).withColumn("_bound", F.min(F.when(c("_upto") >= k, c("_most"))).over(by))
    return pairs.where("_bound IS NULL OR _least <= _bound").drop("_least", "_most", "_upto", "_bound")


def candidates(blocks: DataFrame, levels: list[DataFrame], k: int | None, d2: float | None = None) -> DataFrame:
    """(block, node): the leaves that each block (block, box) has to look at."""
    top = levels[-1].select("node", *BOX, "n").collect()  # at most FAN
    nodes = F.array(*(F.struct(*(F.lit(v).alias(name) for name, v in r.asDict().items())) for r in top))
    box = [F.col(c).alias(f"b_{c}") for c in BOX]
    pairs = written(_bounded(blocks.select("block", *box).select("*", F.inline(nodes)), k, d2), "pairs")
    for level in reversed(levels[:-1]):
        small = F.broadcast(level) if level.count() <= BROADCAST else level
        own = pairs.select("block", *(f"b_{c}" for c in BOX), F.col("node").alias("parent"))
        pairs = written(_bounded(own.join(small, "parent").drop("parent"), k, d2), "pairs")
    return pairs.select("block", "node")


def _gathered(rows: DataFrame, name: str, to: str) -> DataFrame:
    """(name, to): the entries of a group, at most LEAF, in the order of their ids."""
    return rows.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("id", "cx", "cy"))).alias(to))


def _met(k: int | None, within: float | None):
    """Of a block's entries and a leaf's: the k nearest of each, or those within the squared distance; as places in the two lists.

    Results are columns, handed on once there are ``HELD``, so a worker holds an Arrow batch of pairs and a piece of the results, however many follow.
    """

    def piece(many: list[tuple[np.ndarray, ...]]) -> pa.Array:
        columns = [pa.array(np.concatenate(c), of.type) for c, of in zip(zip(*many), FOUND.value_type)]
        ends = np.cumsum([0, *(len(one[0]) for one in many)], dtype="int32")
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(FOUND.value_type)), FOUND)

    @F.arrow_udf("array<struct<a:int,b:int,d2:double>>")
    def met(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            sides, ready, held = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in batch], [], 0
            for row in range(len(batch[0])):
                x, y, u, v = (of[at[row] : at[row + 1]] for at, of in sides)
                dx, dy = x[:, None] - u[None, :], y[:, None] - v[None, :]
                d2 = dx * dx + dy * dy
                if k is None:
                    a, b = np.nonzero(d2 <= within)
                else:
                    b = np.argsort(d2, axis=1, kind="stable")[:, :k]  # equal distances by id, as the entries are in that order
                    a, b = np.repeat(np.arange(len(x)), b.shape[1]), b.ravel()
                ready.append((a.astype("int32"), b.astype("int32"), d2[a, b]))
                held += len(a)
                if held >= HELD:
                    yield piece(ready)
                    ready, held = [], 0
            if ready:
                yield piece(ready)

    return met


def _paired(a: DataFrame, b: DataFrame, k: int | None, d2: float | None) -> DataFrame:
    """(block, place, a_id, b_id, d2) of what the pairs of blocks and leaves give. a and b are written."""
    n_a, n_b = a.count(), b.count()
    if not n_a or not n_b:
        return a.join(b, F.lit(False)).select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("place"), a["id"].alias("a_id"), b["id"].alias("b_id"), F.lit(0.0).alias("d2"))
    b = packed(b, "cx", "cy", "id", LEAF, n_b, "leaf")
    a = packed(a, "cx", "cy", "id", min(LEAF, max(1, ceil(LEAF * n_a / n_b))), n_a, "block")
    pairs = candidates(_boxes(a, "block"), _tree(_boxes(b, "leaf")), k, d2)
    pairs = pairs.join(_gathered(a, "block", "left"), "block").join(_gathered(b.withColumnRenamed("leaf", "node"), "node", "right"), "node")
    found = pairs.select("block", "left", "right", F.explode(_met(k, d2)("left.cx", "left.cy", "right.cx", "right.cy")).alias("p"))
    at = lambda side, i: F.element_at(side, F.col(i) + 1)["id"]
    return found.select("block", F.col("p.a").alias("place"), at("left", "p.a").alias("a_id"), at("right", "p.b").alias("b_id"), F.col("p.d2").alias("d2"))


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, d2): all pairs of a and b, both (id, cx, cy), at most the radius apart, however crowded a place is."""
    return _paired(written(_places(a), "search"), written(_places(b), "catalogue"), None, radius * radius).select("a_id", "b_id", "d2")


def nearest(a: DataFrame, b: DataFrame, k: int = 1) -> DataFrame:
    """(a_id, b_id, d2, rank): the k entries of b nearest to each of a, both (id, cx, cy); equally near ones by id. All of b where it has fewer."""
    if k < 1:
        raise ValueError("k is at least 1")
    same = Window.partitionBy("cx", "cy").orderBy("id")
    b = written(_places(b).withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= k).drop("_same"), "catalogue")
    found = _paired(written(_places(a), "search"), b, k, None)
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy("d2", "b_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("a_id", "b_id", "d2", "rank")
