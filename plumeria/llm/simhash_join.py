"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: words of the A-Z lower-cased text, shingles of ``width`` words, XXH64 (seed 42) of
each; a bit is set where it is set in over half of the hashes. A text of fewer words has one
shingle, the whole sequence; one without words has fingerprint zero.

Links: pairs of distinct fingerprints that differ in at most ``budget`` bits. The 64 bits fall
into blocks; a pair within the budget agrees on all bits of at least ``blocks - budget`` blocks,
so for every choice of that many blocks the fingerprints that agree on them form one trie over
all bits, with the agreed bits first. Each trie is joined with itself: pairs of nodes are walked
down together from (root, root), the bits in which they differ are added up, and a pair is
dropped as soon as they exceed the budget, or when all leaves below both are known to be linked.
What is left at the leaves are exactly the pairs within the budget; a leaf pair costs one union.

Scale: only fingerprints are shuffled (equal ones once); texts are not, but where ``deduplicated``
removes more rows than it may broadcast. Tries with more leaves than
``leaves`` are cut into parts, and each pair of parts is a task of its own, so no task holds more
than twice that many, however many near copies a document has; every pair is still met. More
blocks are agreed on as the fingerprints grow in number, so that tries stay small. A task gives a
spanning forest of the links it found, not all pairs. Components are closed over these by
repeated star contraction, with each round written to the shared folder.

Nulls: a null text has no words. Documents with equal texts share a fingerprint; repeated rows
stay repeated in ``near_duplicates``. A null id can't be a representative; a component of null ids
only has a null id, and in ``deduplicated`` it keeps one row of its own. An empty table gives no rows.
Columns of docs may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.graph import min_reachable as components
from plumeria.llm.common import fresh, give_back, saved, ship, text_key

#: Leaves of a trie (or part of one) that a task takes at once, and fingerprints hashed at once.
LEAVES, HASHES = 1024, 1 << 16
#: Fingerprints that a call of the join gets on average, at most.
BIN = 50_000
#: Rows that a join broadcasts at most, of an id and a key each.
BROADCAST_ROWS = 500_000
#: Node pairs that a walk expands at once; beyond it, it goes depth first over halves.
FRONTIER = 1 << 12
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def hashes(text: str | None, width: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the shingles in order, HASHES at a time; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = _WORDS(text.encode().translate(_LOWER)) if text else []
    if not words:
        return
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, HASHES):
        yield np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + HASHES], ends[at : at + HASHES])], dtype=np.uint64)


def bits_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes."""
    over, n = np.zeros(64, dtype=np.int64), 0
    for some in parts:
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        over += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(over * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return bits_of(hashes(text, width, seed))


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))
        give_back()

    return fp(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp)"""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp"))


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block; widths differ by one at most."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def tries(fps: DataFrame, budget: int, blocks: int) -> DataFrame:
    """(trie, prefix, fp): each fingerprint once in the trie of every choice of blocks to agree on."""
    edges = block_edges(blocks)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        prefix, at = F.lit(0).cast("long"), 0
        for b in chosen:
            low, width = edges[b]
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
            prefix = prefix.bitwiseOR(F.shiftleft(part, at))
            at += width
        keys.append(F.struct(F.lit(k).alias("trie"), prefix.alias("prefix")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.trie", "k.prefix", "fp")


def _find(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _roots(up: np.ndarray) -> np.ndarray:
    """The root of every leaf; shortens the paths in up on the way."""
    while True:
        over = up[up]
        if (over == up).all():
            return over
        up[:] = over


def join_trie(fps: np.ndarray, budget: int, up: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Labels of the leaves (sorted distinct uint64): the components of the links within the budget.

    side: with it, only pairs of leaves from different sides are asked for (others may be linked too).
    """
    n = len(fps)
    up = np.arange(n) if up is None else up
    root = np.array([[0, n, 0, n, 63, 0]])  # two ranges of leaves, the bit below which they are to be split, bits that differ
    stack = [root]
    while stack:
        walk = stack.pop()
        if len(walk) > FRONTIER:
            half = len(walk) // 2
            stack += [walk[:half], walk[half:]]
            continue
        label = _roots(up)
        runs = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        a0, a1, b0, b1, bit, diff = walk.T
        known = (runs[a0] == runs[a1 - 1]) & (runs[b0] == runs[b1 - 1]) & (label[a0] == label[b0])
        if side is not None:
            sides = np.concatenate(([0], np.cumsum(side)))
            in_a, in_b = sides[a1] - sides[a0], sides[b1] - sides[b0]
            known |= (in_a == 0) & (in_b == 0) | (in_a == a1 - a0) & (in_b == b1 - b0)
        walk = walk[~known]
        small = (walk[:, 1] - walk[:, 0]) * (walk[:, 3] - walk[:, 2]) <= 64
        small |= walk[:, 4] < 0
        leaf = walk[small]
        if len(leaf):
            wide = (leaf[:, 3] - leaf[:, 2]).astype(np.int64)
            count = (leaf[:, 1] - leaf[:, 0]) * wide
            which = np.repeat(np.arange(len(leaf)), count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x = leaf[which, 0] + inner // wide[which]
            y = leaf[which, 2] + inner % wide[which]
            near = (x < y) & (label[x] != label[y]) & (np.bitwise_count(fps[x] ^ fps[y]) <= budget)
            for i, j in zip(x[near].tolist(), y[near].tolist()):
                i, j = _find(up, i), _find(up, j)
                if i != j:
                    up[max(i, j)] = min(i, j)
        walk = walk[~small]
        if not len(walk):
            continue
        a0, a1, b0, b1, bit, diff = walk.T
        mask = np.left_shift(np.uint64(1), bit.astype(np.uint64))
        am, bm = _split(fps, a0, a1, mask), _split(fps, b0, b1, mask)
        same = (a0 == b0) & (a1 == b1)
        down = [
            np.stack([a0, am, b0, bm, bit - 1, diff], 1),
            np.stack([am, a1, bm, b1, bit - 1, diff], 1),
            np.stack([a0, am, bm, b1, bit - 1, diff + 1], 1),
            np.stack([am, a1, b0, bm, bit - 1, diff + 1], 1)[~same],
        ]
        down = np.concatenate(down)
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 5] <= budget)]
        if len(down):
            stack.append(down)
    return _roots(up)


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """In each sorted range, where the bit of mask turns to 1 (all higher bits are equal in it)."""
    border = (fps[lo] & ~(mask | (mask - np.uint64(1)))) | mask
    at = np.searchsorted(fps, border)
    return np.clip(at, lo, hi)


def _forest(fps: np.ndarray, budget: int, side: np.ndarray | None) -> pd.DataFrame:
    order = np.argsort(fps, kind="stable")
    fps = fps[order]
    label = join_trie(fps, budget, side=None if side is None else side[order])
    odd = np.flatnonzero(label != np.arange(len(fps)))
    return pd.DataFrame({"a": fps[label[odd]].view(np.int64), "b": fps[odd].view(np.int64)})


def near_links(fps: DataFrame, budget: int = 4, leaves: int = LEAVES, blocks: int | None = None) -> DataFrame:
    """(a, b) fingerprints: forests over distinct fingerprints whose components are those of all links within the budget."""
    n = fps.count()
    if blocks is None:
        # agree on enough bits that an even trie has at most half the leaves of a task
        blocks = budget + 1
        while n >> (64 * (blocks - budget) // blocks) > leaves // 2 and blocks < budget + 4:
            blocks += 1
    placed = tries(fps, budget, blocks)
    sizes = placed.groupBy("trie", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    sizes = saved(sizes.withColumn("parts", F.expr(f"cast((n + {leaves} - 1) div {leaves} as int)")), "tries")
    rows = placed.join(sizes, ["trie", "prefix"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a row of part p goes to the tasks (i, j) of its trie with i = p or j = p, i <= j; whole tries have (0, 0)
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, part).alias("i"), F.greatest(o, part).alias("j"), part.alias("part")),
    )
    rows = rows.select("trie", "prefix", "fp", F.explode(tasks).alias("t")).select("trie", "prefix", "t.i", "t.j", "t.part", "fp")
    # many small tries share a call: a group is a bin of tries, of some BIN rows at most on average
    bins = max(16 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * comb(blocks, budget) // BIN)
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("trie", "prefix", "i", "j"), F.lit(bins)))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, i, j), g in pdf.groupby(["trie", "prefix", "i", "j"], sort=False):
            if len(g) > 1:
                fp = g["fp"].to_numpy().view(np.uint64)
                out.append(_forest(fp, budget, None if i == j else (g["part"].to_numpy() == j)))
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})

    return rows.groupBy("bin").applyInPandas(links, "a long, b long").distinct()


def classes(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, component_id) of every fingerprint in prints (doc_id, fp): the smallest id reached over links."""
    least = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    closed = components(near_links(least.select("fp"), budget))
    # the smallest id of each component of fingerprints, for those that have links
    named = closed.join(least.withColumnRenamed("fp", "node"), "node")
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = saved(closed.join(roots, "root").select(F.col("node").alias("fp"), "component_id"), "classes")
    return saved(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that a document reaches over links, its own included."""
    prints = saved(fingerprints(docs, width, id_col, text_col), "fingerprints")
    out = prints.join(classes(prints, budget), "fp")
    return out.select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs without all but the first of each class. named: (id, key, root) of each row, key as :func:`text_key`.

    First is the smallest id, null ids after all others, then the smallest key; of rows that tie in both,
    one stays. What leaves is written and joined by id and key, so a text is shuffled only where the rows
    that leave are too many to broadcast (``BROADCAST_ROWS``).
    """
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = named.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = named.join(saved(first.select("root", "first"), "first"), "root").where(~rank.eqNullSafe(F.col("first")))
    gone_id, gone_key = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_key")
    gone = saved(rows.select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (text_key(F.col(text_col)) == F.col(gone_key)), "left_anti")
    ties = named.groupBy("id", "key").count().where("count > 1").select(F.col("id").alias(gone_id), F.col("key").alias(gone_key))
    ties = saved(ties, "ties")
    n = ties.count()
    if n:
        key = fresh(docs.columns, "text_key")
        kept, ties = kept.withColumn(key, text_key(F.col(text_col))), F.broadcast(ties) if n <= BROADCAST_ROWS else ties
        same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
        once = kept.join(ties, same, "left_semi").dropDuplicates([id_col, key])
        kept = kept.join(ties, same, "left_anti").unionByName(once).drop(key)
    return kept


def deduplicated(docs: DataFrame, budget: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of links: the first as :func:`keep_first` orders them. All columns stay."""
    ship(docs.sparkSession)
    prints = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), fingerprint_column(F.col(text_col), width).alias("fp"))
    prints = saved(prints, "fingerprints")
    roots = components(near_links(prints.select("fp").distinct(), budget))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("id", "key", F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, named, id_col, text_col)
