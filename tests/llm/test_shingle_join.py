"""Near duplicates against brute-force Jaccard over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumeria.llm import shingle_join as J
from plumeria.llm import simhash_join as S


def shingles(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = up[i], up[j]
                if x != y:
                    up = [y if u == x else u for u in up]
    return sorted(min(rows[k][0] for k in range(len(rows)) if up[k] == u) for u in set(up))


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = "e%d" % r.randrange(10**6)
    return words


def docs_of():
    """Copies with 0 to 6 words of 100 to 200 changed, chains of them, a common line in all others."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = ["w%d" % r.randrange(3000) for _ in range(r.choice([4, 8, 100, 150, 200]))]
        texts.append(base)
        for _ in range(r.randrange(5)):
            base = edited(r, base, min(len(base) // 4, r.randrange(7))) if r.random() < 0.5 else edited(r, texts[-1], min(len(texts[-1]) // 4, 2))
            texts.append(base)
    common = ["c%d" % k for k in range(60)]
    texts += [common + ["u%d" % r.randrange(10**6) for _ in range(r.choice([5, 14, 40]))] for _ in range(40)]
    texts += [edited(r, ["h%d" % k for k in range(120)], r.choice([1, 2, 3])) for _ in range(60)]
    for n in (508, 520, 1022, 1030):  # on both sides of a number of parity bits
        base = ["l%d" % r.randrange(10**5) for _ in range(n)]
        texts += [base] + [edited(r, base + ["t%d" % k] * k, k) for k in (3, 8, n // 60, n // 50, n // 45, n // 40, n // 30)]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "A b"), (903, "a B")]


@pytest.mark.parametrize("sample", [5000, 0])
def test_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(J, "SAMPLE", sample)
    rows = docs_of()
    if not sample:  # the shuffled ways, and repeated rows
        monkeypatch.setattr(J, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
        rows += rows[:9] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_x", F.lit(1))
    kept = J.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_stage_links_similarity_of_four_fifths(spark, sf_dir):
    """Copies with a few words changed lie beyond four bits of the fingerprint."""
    r = random.Random(4)
    base = ["w%d" % r.randrange(3000) for _ in range(120)]
    rows = [(k, " ".join(edited(r, base, 1))) for k in range(8)] + [(20 + k, " ".join("w%d" % r.randrange(3000) for _ in range(120))) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.doc_id for x in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, sf_dir).collect())
    assert got == kept_by_brute_force(rows) == [0, 20, 21, 22, 23]


@pytest.mark.parametrize("parts", [1, 5])
def test_shared_places_lose_no_shingle(spark, parts):
    """Every shingle of two nodes or more is kept with all its nodes, wherever the ranges are cut."""
    r = random.Random(3)
    rows = [(k // 2, k, 9, [r.randrange(40) if r.random() < 0.5 else 1000 + 50 * k + i for i in range(6)]) for k in range(60)] + [(70 + k, 500 + k, 9, [7, 5000 + k]) for k in range(80)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(x.h, x.node) for x in J.shared_places(spark.createDataFrame(rows, "node long, key long, n int, prefix array<long>")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    nodes = {}
    for node, _, _, prefix in rows:
        for h in prefix:
            nodes.setdefault(h, set()).add(node)
    want = {(h, n) for h, ns in nodes.items() if len(ns) > 1 for n in ns}
    assert want <= got and len(got - want) <= 2 * parts


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "other words in here too")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in J.deduplicated(docs).collect()) == ["5", "None"]
    assert J.deduplicated(docs.limit(0)).count() == 0
