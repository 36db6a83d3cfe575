import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from plumeria.llm import byte_bpe, token_counts

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def odd_texts():
    r = random.Random(4)
    some = ["", " ", "  ", "\n", " \n\t ", "▁", "a ▁ b", "a  ", "<s> </s> <unk> <0x41> <|endoftext|>", "x" * 5000, "ab" * 3000 + " " * 300, "\x00\x1c\x85  é漢😀²½ªſ", "can't WE'LL they've  9½ ³"]
    return some + ["".join(r.choice(" \n\t▁aàbthe.é　漢😀\x00<s>'1²") for _ in range(r.randint(0, 80))) for _ in range(1500)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


@pytest.mark.parametrize("source", ["odd", "table"])
def test_counts_equal_the_library(spark, source):
    texts = [None, *odd_texts()] if source == "odd" else [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(frame(spark, texts), MODEL).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}


def test_every_proven_part_is_one_token():
    parts = token_counts.part_counts(MODEL)
    assert len(parts.proven) > 25_000
    for part in random.Random(1).sample(sorted(parts.proven), 3000):
        assert parts.merged(part) == parts.proven[part] if part not in (" ", *parts.breaks) else True


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_PARTS", 100)
    parts = token_counts.PartCounts(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in range(50):
        t = " ".join(f"zq{i}x{j}" for j in range(20))
        assert parts.count(t) == len(sp.encode(t))
    assert len(parts) <= 102 + len(parts.proven)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(name):
    ranks = byte_bpe.read_ranks(P.path(name))
    ours = byte_bpe.ByteBpe(ranks, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in odd_texts():
        ids = memoryview(ours.encode(t)).cast("I").tolist()
        assert ids == theirs.encode_ordinary(t), t
        assert ours.decode(ours.encode(t)) == t.encode()


def test_random_bytes_equal_the_merges():
    ranks = byte_bpe.read_ranks(RANKS)
    ours, r = byte_bpe.codec(RANKS, P.PATTERN), random.Random(2)
    for _ in range(1500):
        data = bytes(r.choice(b"aaabtheing \xc3\xa9\xe6\xbc\xff") for _ in range(r.randint(1, 24)))
        *_, merged = byte_bpe.merges(data, ranks)
        assert ours.encode_part(data) == [ranks[p] for p in merged]


def test_digests_and_round_trip(spark):
    texts = [None, *odd_texts()[:300]]
    docs = frame(spark, texts)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for r in byte_bpe.digests(docs, RANKS, P.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = theirs.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert token_counts.count_tokens(docs.limit(0), MODEL).count() == 0
