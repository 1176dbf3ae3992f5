"""Byte-level BPE by way of a sentencepiece model serialised directly from a rank file (operator 2).

The vocabulary's byte strings become pieces by a fixed byte-to-character map;
each piece scores its negative rank and normalisation is the identity, so
sentencepiece merges the pair of lowest rank first, leftmost on ties, as the
rank file means it. A text is cut into pre-tokens, each encoded by itself;
decoding is the inverse mapping of ids to byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import short_batches, strings, text_only

#: A process keeps at most so many encoded chunks; the memory is cleared when full, which changes no result.
CACHE_CHUNKS = 400_000
#: Bytes of a longer chunk are not kept.
CACHE_CHARS = 64

MULTI_50K = "byte_bpe_multi_50k.tiktoken"

#: Two blanks that no chunk boundary may part: a space between white space, or before the end.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_chars() -> str:
    """A printable character for each byte: itself where it is printable Latin-1, else from 256 up."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in kept else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the ranks; piece 0 is the unknown piece, piece r + 1 has rank r."""
    by_rank = {r: b for b, r in ranks.items()}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps or repeats")
    chars = byte_chars()
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for r in range(len(by_rank)):
        piece = "".join(chars[b] for b in by_rank[r]).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-r))))
    off = (1 << 64) - 1  # -1: the model has no such piece
    out.append(_field(2, _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, 0) + _field(41, off) + _field(42, off) + _field(43, off)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe(dict):
    """Encoder and decoder of one rank file. As a dict it holds the ids of the chunks met so far."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        self.ranks = read_ranks(path)
        self.bytes_of = [b for b, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_chars()))

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for pre in self.find(chunk):
            raw = pre.encode()
            rank = self.ranks.get(raw)  # a pre-token that is a piece stands for itself
            if rank is None:
                ids.extend([i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.chars))])
            else:
                ids.append(rank)
        out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        Pre-tokens never cross a single space that ends a run of non-blanks, so
        chunks that begin there are encoded once and remembered.
        """
        if _UNSAFE.search(text):
            return self.__missing__(text)
        first, *rest = text.split(" ")
        get = self.__getitem__
        return get(first) + b"".join([get(" " + x) for x in rest]) if rest else get(first)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@cache
def encoder(path: str) -> ByteBpe:
    """One encoder a process and rank file."""
    return ByteBpe(path)


def encode_decode(docs: DataFrame, ranks_path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes; keep_ids
    adds ids, the little-endian 32-bit ids themselves. Null and empty texts have
    no tokens and the digest of nothing. Repeated rows give repeated results;
    other columns are left behind; an empty table gives an empty one. There is
    no shuffle: each task needs its own rows and the rank file alone.
    """
    short_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            n, a, b, size, kept = [], [], [], [], []
            for text in strings(batch, "text"):
                ids = bpe.encode(text)
                raw = bpe.decode(np.frombuffer(ids, "<u4"))
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(raw).hexdigest())
                size.append(len(raw))
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(size, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return text_only(docs).mapInArrow(run, T.StructType(fields))


def production(docs: DataFrame) -> DataFrame:
    return encode_decode(docs, public_tokenizers.path(MULTI_50K)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("n_bytes"))
