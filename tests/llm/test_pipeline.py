"""The stages against brute force on a whole small table, and on rows with nulls and repeats."""

import hashlib
import os
import sys

import duckdb
import public_tokenizers as P
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from plumeria.llm import byte_bpe, decontaminate, queries, toxicity

sys.path.insert(0, os.path.dirname(__file__))
from test_shingle_join import kept_by_brute_force  # noqa: E402


def test_stages_on_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    good = stages["quality rules"](spark, docs, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = set(con.execute(f"SELECT doc_id FROM ({queries.quality_sql()}) WHERE kept").df()["doc_id"])
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want

    mild = stages["toxicity"](spark, good, sf_dir)
    model = toxicity.fit(good, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id"))))
    rows = good.collect()
    score = dict(zip((r.doc_id for r in rows), model.scores([r.text for r in rows])))
    assert mild.columns == columns and {r.doc_id for r in mild.collect()} == {i for i, s in score.items() if s < 0.5}

    for some in (good, docs):
        unique = stages["SimHash near-dedup"](spark, some, sf_dir)
        assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in some.collect()])

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, docs, sf_dir)
    coded = decontaminate.Index([(k, decontaminate.words_of(t)) for k, t in enumerate(items)])
    bad = set()
    for r in docs.collect():
        c = coded.code(decontaminate.words_of(r.text))
        if len(c) and any(coded._shared(k, c) >= len(x) - coded.edits[k] and decontaminate.infix_distance(x, c)[0] <= coded.edits[k] for k, x in enumerate(coded.coded)):
            bad.add(r.doc_id)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in stages["byte-level BPE"](spark, docs, sf_dir).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_run_applies_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < len(ids) == len(set(ids))


def test_odd_rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "xx", None, 0), (3, None, "en", "s", None), (3, None, "en", "s", None)], base.schema)
    for docs in (base.unionByName(odd).unionByName(base.limit(20)), odd, base.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count(), name


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ["_quality", "_kept", "_toxicity", "_char_distance", "_text", "_fp", "id", "key", "node", "root", "row", "Gone_id", "item_id", "begin", "h"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).select("*", *(F.lit(7).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == 7 for r in rows for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 80
