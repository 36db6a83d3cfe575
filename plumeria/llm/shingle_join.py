"""Near duplicates by the Jaccard similarity of their word shingles: every pair of at least ``similarity``.

The SimHash join of :mod:`simhash_join` with its links completed and verified. Texts are sets of
shingles of ``width`` words (XXH64 hashes, words as there; a text of fewer words has one shingle).
Texts with equal sets are one node. SimHash alone can't give the links: at similarity 0.8
fingerprints differ in up to 17 of 64 bits, which no trie join carries; it proposes the near ones.

All links: in any order of all shingles, two sets of similarity s share one among the first
``n - ceil(s * n) + 1`` of each (their prefixes). Prefixes are joined, so no pair is missed. The order
puts shingles that a sample of the texts has often last; it only decides how many candidates there are.
Candidates come in two rounds, and each is kept by the exact similarity of the two sets. First, pairs by
SimHash tries and of each node with the ends of its shingles' nodes, which are few however many copies
a text has. Second, all pairs whose nodes the first round has left in different components. Before the
sets are fetched, candidates are compared by parities: each hash flips one bit of its text, out of as
many as it has shingles or more (a power of two), so two texts differ in no more bits than their sets
differ in shingles. Twice as many bits are folded to the other's number. No similar pair is lost. The second
round compares parities folded to the least number while it joins, so that pairs that only share frequent
shingles are compared there and go no further; how many it compares still grows with the square of such a group.

Scale: prefixes are put in order once, by ranges of (shingle, node), so that a shingle of many texts is
spread; there, those of one node only fall out, and what is left is small. Texts are read again, not
shuffled, while the candidates' keys can be broadcast (``BROADCAST_KEYS``).

Nulls: as in :mod:`simhash_join`; texts without words are one node. Columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.functions.graph import min_reachable as components
from plumeria.llm.common import give_back, saved, ship, text_key
from plumeria.llm.simhash_join import bits_of, hashes, keep_first, near_links

SIMILARITY, WIDTH, BUDGET = 0.8, 5, 4
#: Bits of parity at least.
PARITIES = 512
#: Texts whose shingles are counted for the order: so many, or this share of more; and frequent shingles held, at most.
SAMPLE, SHARE, FREQUENT = 5_000, 0.02, 200_000
#: Rows that a join broadcasts at most, of a node, an id and a key each.
BROADCAST_KEYS = 500_000


def prefix_length(n: int, similarity: float) -> int:
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.concatenate([np.array([], np.uint64), *hashes(text, width)]))


def shingle_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in texts], dtype=object)

    return sets(F.coalesce(text, F.lit("")))


def frequent(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, place of each by frequency) of the shingles that a sample has more than twice."""
    share = max(SHARE, SAMPLE / max(1, docs.count()))
    texts = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(10_000)) < int(share * 10_000)).distinct()
    counts = texts.select(F.explode(shingle_sets(F.col(text_col), width)).alias("h")).groupBy("h").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order


def described(docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, node, fp, n, prefix, parity) of each row of docs, n the size of its set."""
    ship(docs.sparkSession)
    common = docs.sparkSession.sparkContext.broadcast(frequent(docs, width, text_col))

    @F.pandas_udf("node long, fp long, n int, prefix array<long>, parity array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        known, place = common.value
        for texts in batches:
            rows = []
            for t in texts:
                parts = list(hashes(t, width))
                h = np.unique(np.concatenate([np.array([], np.uint64), *parts]))
                late = np.zeros(len(h), np.int64)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = np.where(known[at] == h, place[at], 0)
                first = h[np.lexsort((h, late))][: prefix_length(len(h), similarity)]
                both = np.array([xxh64_intdigest(h.tobytes()), bits_of(parts)], np.uint64).view(np.int64)
                bits = max(PARITIES, 1 << (len(h) - 1).bit_length())
                odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                rows.append((both[0], both[1], len(h), first.view(np.int64), np.packbits(odd).view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "fp", "n", "prefix", "parity"])
        give_back()

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), describe(F.coalesce(text, F.lit(""))).alias("t")).select("id", "key", "t.*")


def shared_places(rows: DataFrame) -> DataFrame:
    """(h, node, n, at): the prefixes' shingles that more than one node has, and a few others.

    The rows lie in ranges by (h, node); each task looks at neighbours, and keeps what stands at its borders.
    """
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    rows = rows.select("node", "n", "key", F.posexplode("prefix").alias("at", "h")).select("h", "node", place.alias("place"), "key")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the key of the text parts rows of one node, if it has many
    rows = rows.repartitionByRange(parts, "h", "node", "key").select("h", "node", "place").sortWithinPartitions("h", "node")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple[np.ndarray, ...] = ()
        met = True  # the pending row is kept whatever comes: it is the first, or one before it has its shingle
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if pending:
                columns = [np.concatenate(c) for c in zip(pending, columns)]
            h, node, _ = columns
            new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
            columns = [c[new] for c in columns]
            like_next = columns[0][1:] == columns[0][:-1]
            keep = np.append(met, like_next)
            met = bool(keep[-1])
            keep = keep[:-1] | like_next
            pending = tuple(c[-1:] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in columns], ["h", "node", "place"])
        if pending:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, pending)), ["h", "node", "place"])
        give_back()

    rows = saved(rows.mapInArrow(shared, "h long, node long, place long"), "places")
    return rows.select("h", "node", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("at"))


def _sizes(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-9


def _parities_apart(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def _most_apart(a_n: str, b_n: str, similarity: float) -> Column:
    """Shingles of one set only that two sets of these sizes may have."""
    return (F.col(a_n) + F.col(b_n)) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def least_parity(parity: str) -> Column:
    """The parity folded to ``PARITIES`` bits, so that any two can be compared."""
    k = PARITIES // 64
    part = lambda i: F.aggregate(F.sequence(F.lit(i + 1), F.size(parity), F.lit(k)), F.lit(0).cast("long"), lambda v, j: v.bitwiseXOR(F.element_at(parity, j)))
    return F.when(F.size(parity) == k, F.col(parity)).otherwise(F.array(*map(part, range(k))))


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sizes and parities (node, n, parity) allow the similarity."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("parity").alias(f"{k}_parity")) for k in "ab")
    short = F.least(F.size("a_parity"), F.size("b_parity"))

    def folded(c: str) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) > short, halves).otherwise(F.col(c))

    near = _parities_apart(folded("a_parity"), folded("b_parity")) <= _most_apart("a_n", "b_n", similarity)
    pairs = pairs.join(a, "a").join(b, "b").where(_sizes("a_n", "b_n", similarity) & near)
    return saved(pairs.select("a", "b"), "possible")


def fetched(pairs: DataFrame, rows: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes of pairs, from the texts of docs; rows tells which rows a node has."""
    held = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    row = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key")))
    keys = rows.select("node", "id", "key").join(held, "node", "left_semi").groupBy("node").agg(row.alias("row"))
    keys = saved(keys.select("node", F.col("row.id").alias("own_id"), F.col("row.key").alias("own_key")), "keys")
    n = keys.count()
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    texts = texts.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, one)

    @F.pandas_udf("array<long>")
    def own(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The set, or null where the text is another one with the same key."""
        from xxhash import xxh64_intdigest

        for some, nodes in batches:
            sets = [shingle_set(t, width) for t in some]
            ids = [np.array([xxh64_intdigest(h.tobytes())], np.uint64).view(np.int64)[0] for h in sets]
            yield pd.Series([h.view(np.int64) if i == n else None for h, i, n in zip(sets, ids, nodes)], dtype=object)
        give_back()

    sets = saved(texts.select("node", own("text", "node").alias("hashes")).where("hashes is not null"), "sets")
    # rows may be repeated
    return sets if sets.count() <= n else saved(sets.dropDuplicates(["node"]), "sets")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, hashes) are similar."""
    a, b = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    either = F.size("a_hashes") + F.size("b_hashes") - both
    near = both >= either * F.lit(similarity) - 1e-9
    return saved(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"), "similar")


def near_nodes(rows: DataFrame, docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of every linked node of rows (as :func:`described`): the components of all pairs of the similarity."""
    nodes = saved(rows.select("node", "fp", "n", "parity").dropDuplicates(["node"]), "nodes")
    places = shared_places(rows)
    ends = saved(places.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "ends")
    places = saved(places.join(ends, "h"), "places")

    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = places.select(F.explode(F.array(pair(F.col("node"), F.col("lo")), pair(F.col("node"), F.col("hi")))).alias("p")).select("p.*")
    by_fp = saved(nodes.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    same = nodes.join(by_fp, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = near_links(by_fp.select("fp"), BUDGET)
    links = links.join(by_fp.toDF("a", "x"), "a").join(by_fp.toDF("b", "y"), "b").select(pair(F.col("x"), F.col("y")).alias("p")).select("p.*")
    first = possible(stars.unionByName(same).unionByName(links).where("a < b").distinct(), nodes, similarity)
    found = similar(first, fetched(first, rows, docs, width, id_col, text_col), similarity)

    places = places.select("h", "node", "n", "at").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    places = saved(places, "places")
    mixed = saved(places.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h"), "mixed")
    # nodes of shingles that link different components, with parities: the join below lets few pairs out
    open_ = places.join(mixed, "h", "left_semi").join(nodes.select("node", least_parity("parity").alias("parity")), "node")
    open_ = saved(open_.select("h", "node", "n", "at", "root", "parity"), "open")
    x, y = (open_.select("h", *(F.col(c).alias(f"{k}_{c}") for c in ("node", "n", "at", "root", "parity"))) for k in "xy")
    # at the first shingle that two sets share, all others that they share are still to come
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = rest >= (F.col("x_n") + F.col("y_n")) * F.lit(similarity / (1 + similarity)) - 1e-6
    near = _parities_apart(F.col("x_parity"), F.col("y_parity")) <= _most_apart("x_n", "y_n", similarity)
    more = x.join(y, "h").where((F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & _sizes("x_n", "y_n", similarity) & enough & near)
    more = possible(more.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct(), nodes, similarity)
    more = saved(more.join(first, ["a", "b"], "left_anti"), "pairs")
    return components(found.unionByName(similar(more, fetched(more, rows, docs, width, id_col, text_col), similarity)))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the first as :func:`simhash_join.keep_first` orders them."""
    rows = saved(described(docs, similarity, width, id_col, text_col), "described")
    roots = near_nodes(rows, docs, similarity, width, id_col, text_col)
    named = rows.select("id", "key", "node").join(roots, "node", "left").select("id", "key", F.coalesce("root", "node").alias("root"))
    return keep_first(docs, named, id_col, text_col)
