import pickle
import random

import numpy as np
import pytest

from plumeria.llm import decontaminate as D


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_infix_distance_against_all_passages():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 10))
        e, s, t = D.infix_distance(a, b)
        assert e == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert distance(a, b[s:t]) == e


def sample(seed=2):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 60
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, words(r.randint(12, 60))) for i in range(60)]
    docs, want = [], []
    for rate in (0, 0.05, 0.1, 0.15, 0.19):
        for i, w in items:
            w = list(w)
            for _ in range(int(rate * len(w))):
                p = r.randrange(len(w))
                w[p : p + 1] = r.choice([[], [r.choice(vocab)], [w[p], r.choice(vocab)]])
            docs.append(words(r.randint(0, 80)) + w + words(r.randint(0, 80)))
            want.append((rate, i))
    docs += [words(300) for _ in range(60)]
    return items, docs, want


def test_recall_and_verification_against_brute_force():
    items, docs, want = sample()
    index = D.Index(items)
    found = index.matches([index.code(d) for d in docs])
    for d, k, b, e, edits in found:
        assert distance(items[k][1], docs[d][b:e]) == edits <= 0.2 * len(items[k][1])
    got = {(d, index.items[k][0]) for d, k, *_ in found}
    brute = set()
    for d, doc in enumerate(docs):
        c = index.code(doc)
        for k, (i, _) in enumerate(index.items):
            if len(c) and D.infix_distance(index.coded[k], c)[0] <= index.edits[k]:
                brute.add((d, i))
    assert got <= brute and len(got) >= 0.95 * len(brute)
    copies = {(n, i) for n, (rate, i) in enumerate(want) if rate == 0}
    assert copies <= got


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.19])
def test_recall_is_what_was_asked_for(rate):
    """At every rate of edits, substitutions, insertions and deletions alike; fewer walks where less is asked."""
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 60
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, words(r.randint(12, 120))) for i in range(300)]
    docs = []
    for _, w in items:
        w = list(w)
        for _ in range(int(rate * len(w))):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], [r.choice(vocab)], [w[p], r.choice(vocab)]])
        docs.append(words(r.randint(0, 80)) + w + words(r.randint(0, 80)))
    for recall in (0.95, 0.6):
        index = D.Index(items, recall=recall)
        found = {d for d, k, *_ in index.matches([index.code(d) for d in docs]) if index.items[k][0] == d}
        assert len(found) >= recall * len(docs)
    assert D.walks_for(0.6, 0.8) < D.walks_for(0.95, 0.8) < D.walks_for(0.99, 0.8)


def test_windows_are_sized_by_the_item():
    assert all(D.window_size(n) == n for n in range(1, 6)) and all(0.75 * n <= D.window_size(n) <= 0.9 * n for n in range(7, 5000))


def test_index_does_not_grow_with_the_walks():
    """What is broadcast grows with the items' words: no table of steps times vocabulary."""
    words = [[f"w{i}_{j}" for j in range(400)] for i in range(50)]
    size = [len(pickle.dumps(D.Index(list(enumerate(words[:n]))))) for n in (25, 50)]
    assert size[1] < 2.2 * size[0] and size[1] < 2000 * 50 * 400


def test_items_that_share_a_passage():
    """A thousand items with one preamble, in a document that holds it: few are looked at, and the right one is found."""
    r = random.Random(5)
    words = lambda n: ["w%d" % r.randrange(5000) for _ in range(n)]
    preamble = words(25)
    items = [(i, preamble + words(60)) for i in range(1000)]
    index = D.Index(items)
    doc = index.code(words(300) + preamble + words(300) + items[77][1] + words(50))
    looked = index.candidates(doc)[0]
    assert [(index.items[k][0], e) for _, k, *_, e in index.matches([doc])] == [(77, 0)] and len(looked) < 50_000


def test_frame_edges(spark):
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten."), (2, None), (3, "..."), (4, "short item"), (5, "a a a a a a a a")], "item_id long, text string")
    rows = [(1, "x ONE two, three four five six seven eight nine ten y"), (1, "x ONE two, three four five six seven eight nine ten y"), (2, None), (3, ""), (None, "short item here"), (4, "one two three"), (5, "one two three four five SIX seven ate nine ten " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS begin", "2 AS item_id")
    got = D.find_passages(docs, bench).collect()
    by = sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in got if r["item_id"] in (1, 4))
    assert by.count((1, 1, 0)) == 2 and (0, 4, 0) in by and sum(x[0] == 5 for x in by) == 500
    assert {(r["begin"], r["end"]) for r in got if r["doc_id"] == 1} == {(1, 11)}
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4"]
    assert D.find_passages(docs.limit(0), bench).count() == 0 and D.find_passages(docs, bench.limit(0)).count() == 0


def test_blocks_find_the_same(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(D.find_passages(docs, bench))
    assert whole and {r[:2] for r in whole} == {r[:2] for r in key(D.find_passages(docs, bench, block_words=600))}


def test_blocks_come_one_at_a_time(spark, sf_dir, monkeypatch):
    """An index is built when its block is due, what it finds is written before the next, and no plan holds two of them."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    done, build, save = [], D.walks_for, D.saved
    monkeypatch.setattr(D, "walks_for", lambda *a: done.append("index") or build(*a))
    python = lambda df: str(df._jdf.queryExecution().executedPlan()).count("ArrowEvalPython")
    monkeypatch.setattr(D, "saved", lambda df, name: done.append(python(df)) or save(df, name))
    whole, kept = D.decontaminated(docs, bench), D.decontaminated(docs, bench, block_words=600)
    assert done[0] == "index" and done[1:] == ["index", 1] * (len(done) // 2) and len(done) > 6
    assert python(whole) == 1 and python(kept) == 0
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in kept.collect())
    done.clear()
    assert python(D.find_passages(docs, bench, block_words=600)) == 0 and done == ["index", 1] * (len(done) // 2) and len(done) > 6


def test_far_similarities_are_refused():
    assert D.walks_for(0.95, 0.75) < D.MOST_WALKS
    with pytest.raises(ValueError, match="walks"):
        D.walks_for(0.95, 0.5)


def test_planted_copies_are_all_found(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_passages(docs, bench).collect()}
    assert want and want <= got


def test_null_item_ids_are_searched(spark):
    bench = spark.createDataFrame([(None, "nine ten eleven twelve thirteen fourteen"), (7, "nine ten eleven twelve thirteen fourteen"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x nine ten eleven twelve thirteen fourteen y"), (2, "clean"), (None, "nine ten eleven twelve thirteen fourteen"), (1, "clean too")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"]) for r in D.find_passages(docs, bench).collect())
    assert got == [("1", "7", 0), ("1", "None", 0), ("None", "7", 0), ("None", "None", 0)]
    assert sorted((r["doc_id"], r["text"]) for r in D.decontaminated(docs, bench).collect()) == [(1, "clean too"), (2, "clean")]
