import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumeria.llm import simhash_join as S


def slow_fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def closure(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i]] + [label[j] for j in range(n) if linked(i, j)]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \n\x0b", "A b", "a b c d", "É x Y z q B B B B B", "w\x85x \x1c y " * 50, "one two three four five " * 30000])
def test_fingerprint(text):
    if text and len(text) > 10_000:
        assert S.fingerprint(text) == slow_fingerprint(text)
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_hash_is_that_of_the_engine(spark):
    got = spark.sql("SELECT xxhash64('the quick é') AS h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest("the quick é".encode(), seed=42)


def balls(n, centres, spread, seed):
    rng = np.random.default_rng(seed)
    f = rng.integers(0, 2**64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(spread):
        f ^= np.left_shift(np.uint64(1), rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(f)


@pytest.mark.parametrize("n,centres,spread", [(1, 1, 0), (40, 4, 6), (300, 5, 3), (500, 3, 8), (400, 400, 0), (600, 1, 2)])
def test_trie_walk_against_all_pairs(n, centres, spread):
    f = balls(n, centres, spread, n)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.where(near, label[None, :], len(f)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (S.join_trie(f, 4) == label).all()


@pytest.mark.parametrize("blocks,leaves", [(5, 1024), (6, 1024), (7, 1024), (5, 8)])
def test_links_lose_nothing(spark, blocks, leaves):
    """Whatever the blocks, and with tries cut into parts of 8 leaves, the components are those of all pairs."""
    f = np.concatenate([balls(120, 2, 4, 5), balls(60, 20, 2, 6)])
    f = np.unique(f)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    found = {r.node: r.root for r in S.components(S.near_links(df, 4, leaves, blocks)).collect()}
    want = closure(len(f), lambda i, j: bin(int(f[i] ^ f[j])).count("1") <= 4)
    groups = {}
    for i, x in enumerate(f.view(np.int64).tolist()):
        groups.setdefault(want[i], set()).add(found.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def docs_of(spark):
    r = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 400]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((n * 7 % 1000, " ".join(w)))
            n += 1
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "A"), (1999, "a"), (rows[0][0], rows[0][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))


def test_components_against_brute_force(spark):
    rows, docs = docs_of(spark)
    fps = [slow_fingerprint(t) for _, t in rows]
    label = closure(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    least = {k: min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label)}
    want = sorted((rows[i][0], fps[i], least[label[i]]) for i in range(len(rows)))
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == want
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_chains_of_components(spark):
    rows = [(i, i + 1) for i in range(60)] + [(1000, 999), (7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 1000: 999, 999: 999}


@pytest.mark.parametrize("broadcast", [S.BROADCAST_ROWS, 0])
def test_no_row_is_lost_to_null_ids(spark, monkeypatch, broadcast):
    """Unrelated texts without ids stay, each component keeps one row, and any column name may be taken."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
    r = random.Random(6)
    apart = [" ".join("w%d" % r.randrange(10**6) for _ in range(30)) for _ in range(6)]
    rows = [(None, t) for t in apart] + [(None, apart[0]), (5, apart[1]), (3, apart[1]), (None, None), (None, ""), (9, apart[2]), (9, apart[2]), (9, apart[3])]
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, _chosen_id int, gone_id int, Key int, fp int")
    kept = S.deduplicated(docs)
    # apart[0] twice without an id; apart[1] goes to 3; apart[2] and apart[3] to 9, which has two texts; no words once
    want = sorted([(str(None), apart[0]), ("3", apart[1]), ("9", apart[2]), ("9", apart[3]), (str(None), apart[4]), (str(None), apart[5])])
    got = kept.collect()
    assert kept.columns == docs.columns and sorted((str(x.doc_id), x.text) for x in got if x.text) == want
    assert len(got) == len(want) + 1


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "a b c d e"), (None, "other words in here too")], "doc_id long, text string")
    assert sorted((str(r.component_id) for r in S.near_duplicates(docs).collect())) == ["5", "5", "5", "None"]
    assert sorted(str(r.doc_id) for r in S.deduplicated(docs).collect()) == ["5", "None"]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.deduplicated(docs.limit(0)).count() == 0
