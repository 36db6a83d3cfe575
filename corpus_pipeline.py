"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of documents;
the last gives a digest of each text's encoding. Between stages the rows are written as Parquet in
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm import byte_bpe, decontaminate, quality_divergence, shingle_join, toxicity
from plumeria.llm.common import saved, table
from plumeria.llm.queries import tokenizer_path, tokenizer_pattern


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble a language."""
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")  # packed, so that names can't clash
    return quality_divergence.rate_documents(rows, drop_text=True).where("_kept").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; trained on the labelled ones among docs that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return docs.where(toxicity.score_documents(docs, model) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word similarity of 0.8 or more: that of the smallest id."""
    return shingle_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    return byte_bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: SQL can express neither the trained scores nor the links; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"stage{n}")
    return docs
