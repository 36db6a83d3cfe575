"""Ranked lexical search by pipelined term partitioning.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are
lower-cased. With N documents that hold a term, L terms in all of them, n in one, and df documents that hold a term,

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))      m = 100 - 50 + ((50 * n * N) div L)

and the score of a document for an item is the sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the
item's distinct terms: integers, so the order of additions does not show.

One map over the documents takes blocks of at most ``BLOCK_DOCS`` documents and ``BLOCK_POSTINGS`` postings and writes, for each
block, the places and counts of every term that an item has, and the documents' ids and lengths. The terms are then dealt to
owners by falling weight. Items travel in bundles, each with its own terms: a bundle visits the owners one after another
(a cogroup by block and bundle with that owner's postings) and carries sparse accumulators, places and scores of
the documents that can still be among the first. The last owner's stage gives the first ``top`` of each block and item, which a window ranks.

What travels is pruned without loss: a document whose score, with the most that the terms still ahead can
add, stays below the ``top``-th score that its own block has already reached for the item cannot be among the first. As rare terms come first,
common terms mostly add to the documents that are left and open no new accumulators.

Scale: a posting row belongs to one block and one term, so a term that every document holds is spread over all blocks, and
so is a source, or a group of copies. Texts are read once, nothing of them is shuffled but packed postings of the items' terms; a group of
the cogroup has one block and one bundle. Only the items' terms go to every executor, at most ``PART_TERMS`` at a
time: more are taken in parts, a pass over the documents for each. The final window keeps ``top`` rows of an item in each
task before it shuffles them.

Nulls: null texts, and texts without a term, hold none, match nothing and do not count in N. Items with equal ids (null ones
too) are one query with the terms of all; items without terms have no rows. Documents with equal ids each have their own rank; null
ids come last among equal scores. Repeated rows stay repeated, empty tables give no rows, and other columns play no part.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import LOWER, UPPER, give_back, saved, ship

BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1 << 21  # places in a block have 16 bits
#: Items of a bundle, about; terms that are sent to the executors at a time; owners of terms.
BUNDLE, PART_TERMS, OWNERS = 256, 1_000_000, 4
TOP = 50
#: No term adds more than its weight times this.
MOST = 1_000_000

#: Bytes of UTF-8: letters and digits (A-Z lower-cased) and all bytes beyond ASCII stay, the others part terms.
_BYTES = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)).lower()

POSTINGS = "block long, term binary, n long, docs binary, tf binary, ids array<long>"
ACCUMULATORS = "array<struct<item_id:string,docs:binary,scores:binary,closed:boolean>>"
FOUND = pa.schema([("item_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def terms(text: Column) -> Column:
    """The distinct terms of a text, without Python."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda t: t != ""))


def postings(docs: DataFrame, known: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows of POSTINGS. For each block and known term: n documents, their places in the block (uint16) and counts (int32). With
    ``with_ids`` also a row of each block without a term: its n terms, the documents' numbers of terms (int64, in tf) and their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["block", "term", "n", "docs", "tf", "ids"]
        first, size, lengths, ids, at = None, 0, array("q"), [], {}

        def block() -> pa.RecordBatch:
            rows = [(first, t, len(d), d.tobytes(), f.tobytes(), None) for t, (d, f) in at.items()]
            if with_ids:
                rows.append((first, None, sum(lengths), None, lengths.tobytes(), ids))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

        for b in batches:
            for doc_id, place, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                first = place if first is None else first
                for t, f in Counter(found).items():
                    if t in wanted:
                        if t not in at:
                            at[t] = array("H"), array("i")
                        at[t][0].append(len(ids))
                        at[t][1].append(f)
                        size += 1
                lengths.append(len(found))
                ids.append(doc_id)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield block()
                    first, size, lengths, ids, at = None, 0, array("q"), [], {}
        if ids:
            yield block()
        give_back()

    # a block is named by the place of its first document
    rows = docs.select(F.col(id_col).cast("long"), F.monotonically_increasing_id(), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return rows.mapInArrow(blocks, POSTINGS)


def _stage(owner: int, last: bool, top: int, n_docs: int, n_terms: int):
    """One owner's work on one bundle and block."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return FOUND.empty_table() if last else left.schema.empty_table()
        bundle = left.slice(0, 1).to_pylist()[0]
        lengths = np.frombuffer(bundle["lengths"], np.int64)
        m = 20 * (50 + 50 * lengths * n_docs // n_terms)
        at = {t: (d, f) for t, d, f in zip(*(right.column(c).to_pylist() for c in ("term", "docs", "tf")))}
        gains: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        own: dict[object, list[tuple[bytes, int]]] = {}
        ahead: dict[object, int] = {}
        for t in bundle["terms"]:
            ahead.setdefault(t["item_id"], 0)
            if t["owner"] == owner and t["term"] in at:
                own.setdefault(t["item_id"], []).append((t["term"], t["w"]))
            elif t["owner"] > owner:
                ahead[t["item_id"]] += t["w"] * MOST
        kept = {a["item_id"]: a for a in bundle["acc"]}
        acc, out = [], []
        for item, rest in ahead.items():
            before = kept.get(item)
            score = np.zeros(len(lengths), np.int64)
            closed = False
            if before:
                places = np.frombuffer(before["docs"], np.uint16)
                score[places] = np.frombuffer(before["scores"], np.int64)
                closed = before["closed"]
            for term, w in own.get(item, ()):
                if term not in gains:
                    d, f = np.frombuffer(at[term][0], np.uint16), np.frombuffer(at[term][1], np.int32).astype(np.int64)
                    gains[term] = d, 1_000_000_000 * f // (1000 * f + m[d])
                d, g = gains[term]
                score[d] += w * g
            if closed:  # no other document of the block can still be among the first
                others, score = score, np.zeros(len(lengths), np.int64)
                score[places] = others[places]
            there = np.flatnonzero(score)
            values = score[there]
            least = int(np.partition(values, len(values) - top)[len(values) - top]) if len(values) >= top else 0
            left_in = values + rest >= least
            there, values = there[left_in], values[left_in]
            if last:
                out.append((item, there, values))
            elif len(there) or rest:
                acc.append({"item_id": item, "docs": there.astype(np.uint16).tobytes(), "scores": values.tobytes(), "closed": closed or rest < least})
        if not last:
            return left.slice(0, 1).set_column(left.schema.get_field_index("acc"), left.schema.field("acc"), pa.array([acc], left.schema.field("acc").type))
        rows = []
        for item, there, values in out:
            pick = [(-int(s), bundle["ids"][d] is None, bundle["ids"][d] or 0) for d, s in zip(there.tolist(), values.tolist())]
            rows += [(item, None if null else i, -s) for s, null, i in sorted(pick)[:top]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, FOUND.types)], FOUND.names)

    return work


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0. Ids of documents are integers."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    ship(spark)
    wanted = items.select(F.col(item_col).cast("string").alias("item_id"), F.explode(terms(F.col(item_text)).cast("array<binary>")).alias("term")).distinct()
    wanted = saved(wanted, "item-terms")
    few = wanted.count() <= PART_TERMS  # else the joins with them shuffle
    sent = F.broadcast if few else lambda df: df
    index = _index(docs, saved(wanted.select("term").distinct(), "terms"), id_col, text_col)
    of_block, of_term = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_docs, n_terms = of_block.agg(F.sum(F.size("ids")), F.sum("n")).first()
    weights = of_term.groupBy("term").agg(F.sum("n").alias("df"))
    weights = saved(weights.select("term", F.floor(1000 * F.log((2.0 * (n_docs or 0) + 2) / (2.0 * F.col("df") + 1))).alias("w")).where("w > 0"), "weights")
    if weights.isEmpty():
        return spark.createDataFrame([], "item_id string, rank int, doc_id long, score long").withColumn("item_id", F.col("item_id").cast(kind))
    cuts = weights.approxQuantile("w", [0.5 * 0.25**k for k in range(owners - 1)], 0.001) if owners > 1 else []
    owner = sum(((F.col("w") < c).cast("int") for c in cuts), F.lit(0)).alias("owner")
    n_items = wanted.select("item_id").distinct().count()
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(-(-n_items // BUNDLE))).cast("int").alias("bundle")
    asked = saved(wanted.select("item_id", "term", bundle).join(sent(weights.select("term", "w", owner)), "term"), "asked")
    posted = of_term.select("block", "term", "docs", "tf").join(sent(asked.select("term", "bundle", "owner").distinct()), "term")
    posted = saved(posted, "posted")
    own = asked.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("owner", "item_id", "term", "w"))).alias("terms"))
    now = posted.select("block", "bundle").distinct().join(of_block.select("block", F.col("tf").alias("lengths"), "ids"), "block").join(own, "bundle")
    now = now.select("block", "bundle", "lengths", "ids", "terms", F.array().cast(ACCUMULATORS).alias("acc"))
    for k in range(owners):
        there = posted.where(F.col("owner") == k).select(F.col("block").alias("at_block"), F.col("bundle").alias("at_bundle"), "term", "docs", "tf")
        both = now.groupBy("block", "bundle").cogroup(there.groupBy("at_block", "at_bundle"))
        now = both.applyInArrow(_stage(k, k == owners - 1, top, n_docs, n_terms), "item_id string, doc_id long, score long" if k == owners - 1 else now.schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = now.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def _index(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written postings of the terms, PART_TERMS of them in each pass over the documents."""
    parts, index = max(1, -(-distinct.count() // PART_TERMS)), None
    for p in range(parts):
        known = frozenset(bytes(r["term"]) for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).toLocalIterator())
        part = saved(postings(docs, known, id_col, text_col, with_ids=p == 0), "postings")
        index = part if index is None else index.unionByName(part)
    return index
