"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of words (runs of letters and digits, lower-cased). An item is found where
the edit distance, in words, to some passage of the document is at most ``1 - similarity`` of its
length. Words that no item holds are one symbol, which no sampled symbol of an item equals.

CGK: a random walk over a window copies the symbol it stands on at every step and moves on or
stays by a random bit of (walk, step, symbol). Windows within a small edit distance then agree in most
steps, so sampling a few steps is a locality-sensitive hash of edit distance. Windows are sized by
the item: from 0.78 to 0.9 of its length, on a geometric grid; what is left is room to shift. The
documents' windows begin at every ``stride`` words, the item's at every word, so that each
occurrence has an aligned pair. Before the walk, windows with more foreign words than the item
may have edits are left out, which loses nothing. Hits are extended to the item's whole length and
verified exactly.

Recall: a sample of ``BITS`` steps agrees for a passage with e of n words edited with a chance of about
(1 - CHANGED * e / n)^BITS. From it follows how many samples (walks times ``SAMPLES``) give the ``recall`` asked
for at the most edits that an item may have; copies are always found. Tests measure it.

Scale: one map over whole documents, without a shuffle. The index of a block of items (at most
``BLOCK_WORDS`` words, or one item) is broadcast; a larger benchmark is searched block by block: an index is built when
its block is due, its pass is written, and it is dropped before the next. The random bits are hashed from walk, step and symbol, not held. Items that share a
passage share its keys; candidates are made distinct before they are verified.

Nulls and texts without words match nothing, and so do items without words. Items with a null id are
searched like others. Repeated documents each give their rows; equal items each give theirs. Empty
tables give no rows. :func:`decontaminated` judges each row by its text alone, so ids may be null or
repeated, and keeps all columns; neither function minds how other columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeria.llm.common import give_back, saved, ship

SIMILARITY, RECALL = 0.8, 0.95
SAMPLES, BITS, SEED = 3, 3, 11
#: Steps of a walk that an edit changes, for each step that a word takes; measured over edits of all kinds.
CHANGED = 2.4
#: Words of the items whose index is held at once, and words of documents that are searched together.
BLOCK_WORDS, TOGETHER = 500_000, 500_000
#: Bytes of random bits that are kept from one search to the next.
KEPT_BITS = 32 << 20
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


#: Walks over each window at most. Similarities that take more (below about 0.63) are refused: the method is for near copies.
MOST_WALKS = 2000


def window_size(n: int) -> int:
    """For items of n words: all of a short item, else the largest of a grid (steps of 15 %) that leaves a tenth to shift in."""
    size = 5
    while n >= 6 and (more := max(size + 1, int(size * 1.15))) <= 0.9 * n:
        size = more
    return n if n < 6 else size


def walks_for(recall: float, similarity: float) -> int:
    """Walks with SAMPLES samples each, so that a passage with the most edits is met with this chance."""
    chance = max(0.01, 1 - CHANGED * (1 - similarity)) ** BITS
    walks = max(1, ceil(log(1 - recall) / log(1 - chance) / SAMPLES)) if chance < 1 else 1
    if walks > MOST_WALKS:
        raise ValueError(f"a similarity of {similarity} takes {walks} walks of at most {MOST_WALKS}")
    return walks


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits for each symbol."""
    x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, begin, end): the passage text[begin:end] nearest to the item in edit distance; the first of equals."""
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for k, x in enumerate(item, 1):
        change = np.append(k, np.minimum(cost[:-1] + (text != x), cost[1:] + 1))
        origin = np.append(0, np.where(cost[:-1] + (text != x) <= cost[1:] + 1, begin[:-1], begin[1:]))
        # inserting words of the text: the least of change[j] + (i - j) over j <= i
        level = change - steps
        least = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, begin = least + steps, origin[at]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Index:
    """Items (id, words) by sampled symbols of their windows' walks."""

    def __init__(self, items: list[tuple[object, list[str]]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = SEED):
        self.items = [(i, w) for i, w in items if w]
        self.similarity, self.seed, self.walks = similarity, seed, walks_for(recall, similarity)
        self.symbol: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.symbol.setdefault(x, len(self.symbol) + 1)
        self.pad = len(self.symbol) + 1  # after the end of a window; 0: a word that no item holds
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        self.coded = [np.array([self.symbol[x] for x in w], np.int32) for _, w in self.items]
        self.bags = [np.unique(c, return_counts=True) for c in self.coded]
        self.edits = [int((1 - similarity) * len(c) + 1e-9) for c in self.coded]
        rng = np.random.default_rng(seed)
        by_size: dict[int, list[int]] = {}
        for k, c in enumerate(self.coded):
            by_size.setdefault(window_size(len(c)), []).append(k)
        self.groups = []  # (size, stride, foreign words allowed, samples, tables, items of the windows, their places)
        for size, own in sorted(by_size.items()):
            shift = min(len(self.coded[k]) - size for k in own)
            # one step out of each of BITS equal spans of the walk, so that a sample sees all of the window
            spans = np.linspace(0, 2 * size, min(BITS, size) + 1)
            steps = [[(spans[:-1] + rng.random(len(spans) - 1) * np.diff(spans)).astype(int) for _ in range(SAMPLES)] for _ in range(self.walks)]
            item = np.repeat(own, [len(self.coded[k]) - size + 1 for k in own])
            place = np.concatenate([np.arange(len(self.coded[k]) - size + 1) for k in own])
            text = np.concatenate([self.coded[k] for k in own])
            begin = np.cumsum([0] + [len(self.coded[k]) for k in own[:-1]])
            starts = place + np.repeat(begin, [len(self.coded[k]) - size + 1 for k in own])
            tables = []
            for walk in range(self.walks):
                for keys, rows in self._hash(text, starts, size, walk, steps[walk]):
                    order = np.argsort(keys, kind="stable")
                    tables.append((keys[order], rows[order]))
            self.groups.append((size, shift + 1, max(self.edits[k] for k in own), steps, tables, item, place))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def _bits(self, walk: int, span: int) -> np.ndarray:
        """For each symbol, whether the walk moves on at each of 64 steps."""
        if (walk, span) not in self.kept:
            if (len(self.kept) + 1) * 8 * (self.pad + 1) > KEPT_BITS:
                self.kept.clear()
            self.kept[walk, span] = mixed(np.arange(self.pad + 1, dtype=np.uint64), (self.seed << 40) + (walk << 24) + span + 1)
        return self.kept[walk, span]

    def _hash(self, text: np.ndarray, starts: np.ndarray, size: int, walk: int, samples: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each sample: (keys, numbers) of the windows whose sampled symbols are all of items."""
        need = {int(s) for sample in samples for s in sample}
        seen: dict[int, np.ndarray] = {}
        alive, at = np.arange(len(starts)), starts.astype(np.int32)
        ends = at + size
        open_ = [np.ones(len(at), bool) for _ in samples]  # for each sample, the windows that may still complete it
        for step in range(max(need) + 1):
            x = text.take(at, mode="clip")
            if step >= size:  # before, no walk can have left its window
                x = np.where(at < ends, x, self.pad)
            if step in need:
                held = x > 0
                open_ = [o & held if step in sample else o for o, sample in zip(open_, samples)]
                good = np.logical_or.reduce(open_)
                seen[step] = x
                if np.count_nonzero(good) < 0.9 * len(good):
                    alive, at, ends, x = alive[good], at[good], ends[good], x[good]
                    seen = {s: v[good] for s, v in seen.items()}
                    open_ = [o[good] for o in open_]
            bits, shift = self._bits(walk, step >> 6), np.uint64(step & 63)
            if len(bits) < len(x):
                at = at + ((bits >> shift) & np.uint64(1)).astype(np.int32).take(x)
            else:
                at = at + ((bits.take(x) >> shift) & np.uint64(1)).astype(np.int32)
        for sample in samples:
            key = np.zeros(len(alive), np.uint64)
            good = np.ones(len(alive), bool)
            for s in sample:
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (seen[int(s)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                key ^= key >> np.uint64(29)
                good &= seen[int(s)] > 0
            yield key[good], alive[good]

    def code(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.symbol.get, words, repeat(0)), np.int32, len(words))

    def candidates(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, where in the text they would begin), each pair once. text: symbols of any number of documents."""
        held = np.concatenate(([0], np.cumsum(text > 0)))
        before = max((len(c) for c in self.coded), default=0)  # more than any item can begin before the text
        width = len(text) + before + 1
        found = [np.array([], np.int64)]
        for size, stride, foreign, steps, tables, item, place in self.groups:
            starts = np.arange(0, max(1, len(text) - size + stride), stride)
            ends = np.minimum(starts + size, len(text))
            starts = starts[held[ends] - held[starts] >= size - foreign]
            if not len(starts):
                continue
            # windows that run over the end of the text see fillers
            padded = np.append(text, np.full(size, self.pad, np.int32))
            of_group, at = [], 0
            for walk in range(self.walks):
                for keys, rows in self._hash(padded, starts, size, walk, steps[walk]):
                    sorted_keys, values = tables[at]
                    at += 1
                    lo = np.searchsorted(sorted_keys, keys, "left")
                    n = np.searchsorted(sorted_keys, keys, "right") - lo
                    hit = np.flatnonzero(n)
                    if len(hit):
                        n = n[hit]
                        v = values[np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        of_group.append(item[v].astype(np.int64) * width + np.repeat(starts[rows[hit]], n) - place[v] + before)
            if of_group:
                found.append(np.unique(np.concatenate(of_group)))
        pairs = np.concatenate(found)
        return pairs // width, pairs % width - before

    def _shared(self, k: int, text: np.ndarray) -> int:
        """Words of the item that the text has too, with multiplicity: at least length - edits of them in a match."""
        words, need = self.bags[k]
        place = np.minimum(np.searchsorted(words, text), len(words) - 1)
        have = np.bincount(place[words[place] == text], minlength=len(words))
        return int(np.minimum(have, need).sum())

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, begin, end, edits) of verified passages; passages of an item do not overlap."""
        gap = max((len(c) for c in self.coded), default=0)
        begin = np.cumsum([0] + [len(d) + gap for d in docs])
        text = np.zeros(int(begin[-1]), np.int32)
        for b, d in zip(begin, docs):
            text[b : b + len(d)] = d
        todo: dict[tuple[int, int], set[int]] = {}
        items, places = self.candidates(text)
        middle = np.array([len(c) // 2 for c in self.coded], np.int64)
        of = np.searchsorted(begin, np.maximum(places, 0) + middle[items], "right") - 1
        for doc, k, at in zip(of.tolist(), items.tolist(), places.tolist()):
            if doc < len(docs):
                todo.setdefault((doc, k), set()).add(at - int(begin[doc]))
        out = []
        for (doc, k), places in sorted(todo.items()):
            item, slack, over = self.coded[k], self.edits[k], -1
            tried = None
            for at in sorted(places):
                if at + len(item) <= over or tried is not None and at - tried <= slack // 2:
                    continue  # inside a passage that was found, or covered by the last look
                lo, hi = max(0, at - slack, over), min(len(docs[doc]), at + len(item) + 2 * slack)
                tried = at
                if hi - lo < len(item) - slack:
                    continue
                if self._shared(k, docs[doc][lo:hi]) < len(item) - slack:
                    continue
                edits, b, e = infix_distance(item, docs[doc][lo:hi])
                if edits <= slack:
                    out.append((doc, k, lo + b, lo + e, edits))
                    over, tried = lo + e, None
        return out


def searched(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) of the passages, for groups of texts of TOGETHER words or so."""
    group, first, size = [], 0, 0
    for n, text in enumerate(texts):
        group.append(index.code(words_of(text)))
        size += len(group[-1])
        if size > TOGETHER or n == len(texts) - 1:
            for d, *passage in index.matches(group) if index.items else ():
                yield first + d, *passage
            group, first, size = [], n + 1, 0


def block_indexes(benchmark: DataFrame, similarity: float, recall: float, item_id_col: str, item_text_col: str, block_words: int) -> Iterator[tuple[Broadcast, bool]]:
    """(broadcast index, whether it is the only one) of each block of items. Of several, one is dropped before the next is built: what used it must be written by then."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # at most so many words
    blocks = int(total // block_words) + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["text"], r["item"] is None, 0 if r["item"] is None else r["item"]))
        index = sc.broadcast(Index([(r["item"], words_of(r["text"])) for r in rows], similarity, recall))
        yield index, blocks == 1
        if blocks > 1:
            index.destroy()


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item_id, begin, end, edits, similarity), a row for each passage; begin and end count words."""
    ship(docs.sparkSession)
    kind = benchmark.schema[item_id_col].dataType.simpleString()

    def found(index) -> Column:
        @F.pandas_udf(f"array<struct<item:{kind}, begin:int, end:int, edits:int, similarity:double>>")
        def passages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = index.value
            for texts in batches:
                out: list[list[dict]] = [[] for _ in range(len(texts))]
                for d, k, b, e, edits in searched(texts.tolist(), own):
                    out[d].append({"item": own.items[k][0], "begin": b, "end": e, "edits": edits, "similarity": 1 - edits / len(own.coded[k])})
                yield pd.Series(out, dtype=object)
            give_back()

        return passages(F.coalesce(F.col(text_col), F.lit("")))

    parts = []
    for index, only in block_indexes(benchmark, similarity, recall, item_id_col, item_text_col, block_words):
        part = docs.select(F.col(id_col).alias("id"), F.explode(found(index)).alias("p"))
        parts.append(part if only else saved(part, "passages"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.col("id").alias(id_col), F.col("p.item").alias("item_id"), "p.begin", "p.end", "p.edits", "p.similarity")


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs without the rows whose text holds a passage of the benchmark."""
    ship(docs.sparkSession)

    def held(index) -> Callable[[Column], Column]:
        @F.pandas_udf("boolean")
        def contaminated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = index.value
            for texts in batches:
                out = np.zeros(len(texts), bool)
                for d, *_ in searched(texts.tolist(), own):
                    out[d] = True
                yield pd.Series(out)
            give_back()

        return contaminated

    for index, only in block_indexes(benchmark, similarity, recall, item_id_col, item_text_col, block_words):
        docs = docs.where(~held(index)(F.coalesce(F.col(text_col), F.lit(""))))
        if not only:  # the next block looks at what this one has left
            docs = saved(docs, "block")
    return docs
