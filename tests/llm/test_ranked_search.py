"""Ranked search against plain scoring of every document, with odd rows, ties, small blocks and many owners."""

import random
import re
from collections import Counter
from math import floor, log

import pyarrow as pa
import pytest

from plumeria.llm import queries, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """{item: [(doc_id, score), ...]}; nulls last among ties."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, ts in asked.items():
        rows = []
        for i, c in counted:
            m, s = 50 + 50 * sum(c.values()) * n_docs // n_terms, 0
            for t in ts:
                if t in c:
                    s += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                rows.append((-s, i is None, i or 0))
        if rows:
            out[item] = [(None if null else i, -s) for s, null, i in sorted(rows)[:top]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert all([r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {k: [(i, s) for _, i, s in sorted(v, key=lambda x: x[0])] for k, v in out.items()}


def corpus(spark, seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["É", "ß", "x1", "日本", "a"]) + str(int(r.paretovariate(0.6)) % 400) if r.random() < 0.9 else "the"
    text = lambda k: "".join(word() + r.choice(" -.,\n\t_\x00\x7f") for _ in range(k))
    docs = [(r.choice([None, i, i % 50]), text(r.choice([1, 5, 40, 300])).upper()) for i in range(n)] + [(1, None), (2, ""), (3, " .,;"), (None, None)]
    docs += [(1000 + i, docs[0][1]) for i in range(n // 3)]
    items = [(i % 37, text(r.choice([1, 6, 30]))) for i in range(40)] + [(None, "the x15 a3"), (90, None), (91, "..."), (92, "nowhere"), (93, docs[0][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, 0, "q") for x in docs], "doc_id long, text string, score long, block string").repartition(3)
    return d, spark.createDataFrame([(*x, 0, "q") for x in items], "item_id long, text string, w long, term string")


@pytest.mark.parametrize(("block", "owners", "bundle", "top", "part"), [(10_000, 4, 256, 50, 1000), (16, 4, 5, 3, 1000), (7, 1, 1, 50, 40), (40, 9, 300, 1, 1000)])
def test_equals_plain_scoring(spark, monkeypatch, block, owners, bundle, top, part):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "BUNDLE", bundle)
    monkeypatch.setattr(ranked_search, "PART_TERMS", part)
    docs, items = corpus(spark, block, 250)
    got = found(ranked_search.search(*frames(spark, docs, items), top=top, owners=owners))
    assert got == plain(docs, items, top) and None in got and 93 in got and not {90, 91, 92} & set(got)


def test_bundles_carry_only_what_can_still_be_first(spark):
    """A rare word decides; the common ones open no accumulators for the other documents."""
    docs = [(i, "common filler " + ("rare gem " if i < 60 else "") + "stone " * (i % 3)) for i in range(3000)]
    weights = {b"rare": 3900, b"gem": 3900, b"stone": 400, b"common": 1}
    d, _ = frames(spark, docs, [(1, "")])
    index = ranked_search.postings(d.coalesce(1), frozenset(weights)).collect()
    block = next(r for r in index if r.term is None)
    asked = [{"owner": k, "item_id": "1", "term": t, "w": w} for k, (t, w) in enumerate(weights.items())]
    carried = pa.list_(pa.struct([("item_id", pa.string()), ("docs", pa.binary()), ("scores", pa.binary()), ("closed", pa.bool_())]))
    kinds = pa.schema([("lengths", pa.binary()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.struct([("owner", pa.int32()), ("item_id", pa.string()), ("term", pa.binary()), ("w", pa.int64())]))), ("acc", carried)])
    now, sizes = pa.Table.from_pylist([{"lengths": bytes(block.tf), "ids": block.ids, "terms": asked, "acc": []}], schema=kinds), []
    for k, t in enumerate(weights):
        right = pa.Table.from_pylist([{"term": bytes(r.term), "docs": bytes(r.docs), "tf": bytes(r.tf)} for r in index if r.term == t])
        now = ranked_search._stage(k, k == 3, 50, 3000, block.n)(now, right)
        if k < 3:
            sizes += [len(x["docs"]) // 2 for b in now.column("acc").to_pylist() for x in b]
    assert len(sizes) == 3 and max(sizes) <= 60 and now.num_rows == 50 and set(now.column("doc_id").to_pylist()) <= set(range(60))


def test_empty_tables(spark):
    d, i = frames(spark, *corpus(spark, 1, 5))
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.where("text = ''"), i)):
        out = ranked_search.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_terms():
    text = "Ab-c_D9É\x00ñ ÀZ日本 \x7f\x80x ſK"
    assert [t.decode() for t in ranked_search.terms_of(text.encode())] == terms(text)


def test_ids_of_items_keep_their_type(spark):
    d, i = frames(spark, *corpus(spark, 2, 20))
    out = ranked_search.search(d, i.selectExpr("cast(item_id AS string) AS item_id", "text"))
    assert dict(out.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert queries.QUERIES["op13_ranked_search"]
