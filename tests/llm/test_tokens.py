"""Operators 2, 6 and 8 against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, separators, vbyte

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "Hello world", "  two  spaces \n\n new\tline ", "naïve café — Straße 日本語 🎉", "don't can't I'M <|endoftext|> x", "a" * 30_000, "é" * 500 + " " * 40 + "x", "\n", " ", "0123456789 3.14 !!! ...", "same", "same", "ﬁ ① Å ​ zero width   line", "İstanbul ǅ ß"]


@pytest.fixture(scope="module")
def docs(spark, small):
    own = spark.createDataFrame([(5000 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(5000, "repeated id", "en", "s", 1)], SCHEMA)
    return own.unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"))


def test_byte_bpe_equals_the_library_and_decodes(docs):
    path = public_tokenizers.path(bpe.MULTI_50K)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = sorted((r.doc_id, len(i := enc.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.production(docs).collect())
    assert got == want


def test_model_is_sentencepiece_bpe_without_normalisation():
    b = bpe.encoder(public_tokenizers.path(bpe.MULTI_50K))
    assert b.model.get_piece_size() == len(b.ranks) + 1
    assert b.model.get_score(101) == -100.0
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def test_token_files_give_back_what_was_written(docs):
    tok = Tokenizer.from_file(public_tokenizers.path(vbyte.WORD_49K))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in vbyte.production(docs).orderBy("start").collect()]
    assert got == want


def test_byte_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = vbyte.pack(ranks)
        assert (vbyte.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


@pytest.mark.parametrize(("block", "shard"), [(7, 20), (1 << 18, 1 << 23), (13, 6), (1000, 333)])
def test_token_counts_over_any_blocks_and_shards(docs, block, shard):
    path = public_tokenizers.path(separators.BYTE_50K)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    some = docs.where("doc_id >= 4990 OR doc_id < 40" if shard > 1000 else "doc_id >= 4990").where(f"{shard} > 100 OR doc_id NOT IN (5006, 5007)")
    some = some.unionByName(some.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("no id")})).unionByName(some.limit(1).withColumn("doc_id", F.lit(-(1 << 62))))
    some = some.withColumns({"n_tokens": F.lit("clash"), "task": F.lit(1), "value": F.lit(2)})
    rows = some.collect()
    got = separators.token_counts(some, path, block, shard).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len(enc.encode_ordinary(r.text or ""))) for r in rows)
    at = 0
    for r, (key, n) in zip(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens)), want, strict=True):
        assert ((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.start) == (key, n, at)
        at += n


def test_documents_cross_blocks_and_shards(spark):
    rows = [(0, 0, 0, 4, [1], [7]), (0, 0, 1, 4, [], []), (0, 1, 0, 9, [0, 8], [8, None]), (1, 0, 0, 6, [5], [9])]
    b = spark.createDataFrame(rows, "task int, shard int, block int, n long, ends array<int>, doc_ids array<long>")
    t = separators.TRAILER
    got = sorted((r.task, r.place, r.doc_id, r.n_tokens + t) for r in separators.stitch(b).collect())
    assert got == [(0, 0, 7, 1), (0, 2, 8, 6), (0, 9, None, 7), (1, 0, 9, 5)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.production(none).count() == vbyte.production(none).count() == separators.production(none).count() == 0
