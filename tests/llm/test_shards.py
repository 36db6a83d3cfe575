import random
import zlib

import pytest

from plumeria.llm import shards


def brute(rows, n):
    sized = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, at, out, first = sum(r[1] for r in sized), 0, [], {}
    for k, (i, size, crc) in enumerate(sized):
        shard = at * n // total
        out.append((i, size, crc, shard, k - first.setdefault(shard, k)))
        at += size
    return sorted(out, key=repr)


def rows_of(kind):
    r = random.Random(2)
    if kind == "plain":
        return [(i, "é" * r.randint(0, 300)) for i in range(700)]
    if kind == "odd":
        return [(None, "x"), (None, None), (5, ""), (5, ""), (5, "b"), (-3, "long" * 50_000), (2**62, "z")] + [(5, "same")] * 200
    return []


@pytest.mark.parametrize("kind", ["plain", "odd", "empty"])
@pytest.mark.parametrize("buckets", [1, 7, None])
def test_against_brute_force(spark, kind, buckets):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS shard").repartition(5)
    got = shards.byte_shards(shards.row_sizes(df), 40, buckets).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 40)


def test_balance_and_slots(spark, sf_dir):
    out = shards.shard_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 40).toPandas()
    by = out.groupby("shard")
    assert len(by) == 40 and (by["slot"].max() + 1 == by.size()).all() and (by["slot"].nunique() == by.size()).all()
    assert by["size"].sum().max() - by["size"].sum().min() <= 2 * out["size"].max()
