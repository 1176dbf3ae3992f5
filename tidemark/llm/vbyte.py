"""Token files of frequency-ranked ids in byte-aligned variable-length coding (operator 8).

Each id is replaced by its rank by frequency (0: the commonest, ties by id), so
common ids take one byte. Ranks are coded in groups of four: a control byte
holds four two-bit lengths, and the bytes of the ranks stand in a stream of
their own. Decoding is by numpy: a table of 256 x 4 lengths turns the control
bytes into offsets, and the data bytes are gathered at these offsets.

A file is a run of frames, each followed by one line feed (the separator of
Spark's text writer, which writes the files on any file system). A frame:

    bytes 0-3    magic "TMVB"
    bytes 4-7    number of documents, u32
    bytes 8-15   number of ids, u64
    bytes 16-23  number of data bytes, u64
    then         doc_id of each document, i64; 1 where it was null, else 0, u8; ids of each document, u32;
                 control bytes (ids / 4, rounded up); data bytes
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_chars
from tidemark.llm.common import cut, id_bounds, id_bucket, partitions, shared_dir, short_batches, strings, text_only

WORD_49K = "word_bpe_49k.json"
#: A frame is closed when it holds so many ids.
FRAME_IDS = 1 << 20
#: A process keeps at most so many encoded words; cleared when full, which changes no result.
CACHE_WORDS = 500_000

MAGIC = b"TMVB"
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: Latin letters that normalisation leaves alone and that have one lower-case form, then marks without an apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordBpe(dict):
    """Ids of the words of a text by the tokenizers library; as a dict it holds the words met so far.

    Text is cut at spaces, tabs and line ends, which the tokenizer drops and
    across which neither its normalisation nor its pre-tokens reach. A plain
    word of Latin letters goes to the library's BPE model by itself, as bytes
    written as characters; anything else goes through the library's whole chain.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = _PLAIN.fullmatch
        self.chars = dict(enumerate(byte_chars()))
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        out = self.parts.get(text)
        if out is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            chars = text if text.isascii() else text.encode().decode("latin-1").translate(self.chars)
            out = self.parts[text] = array("H", [t.id for t in self.model.tokenize(chars)]).tobytes()
        return out

    def __missing__(self, word: str) -> bytes:
        if m := self.plain(word):
            letters, marks = m.groups()
            out = self.part(letters.lower()) + (self.part(marks) if marks else b"")
        else:
            out = array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 16-bit integers."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")))


@cache
def tokenizer(path: str) -> WordBpe:
    if Tokenizer.from_file(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    return WordBpe(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks (uint32)."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of some control bytes and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    for k in range(int(size.max(initial=0))):
        out |= np.where(size > k, padded[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def frame(doc_ids: list, counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = MAGIC + len(counts).to_bytes(4, "little") + len(ranks).to_bytes(8, "little") + len(data).to_bytes(8, "little")
    ids = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return head + ids + np.array(counts, "<u4").tobytes() + control + data


def frames(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, counts and ranks of each frame of a file's bytes."""
    at, whole = 0, np.frombuffer(content, np.uint8)
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a token file")
        docs = int.from_bytes(content[at + 4 : at + 8], "little")
        n, size = (int.from_bytes(content[at + k : at + k + 8], "little") for k in (8, 16))
        at += 24
        ids = np.frombuffer(content, "<i8", docs, at).tolist()
        null = whole[at + 8 * docs : at + 9 * docs]
        counts = np.frombuffer(whole[at + 9 * docs : at + 13 * docs].tobytes(), "<u4")
        at += 13 * docs
        control = whole[at : at + -(-n // 4)]
        at += len(control)
        yield [None if z else i for i, z in zip(ids, null.tolist(), strict=True)], counts, unpack(control, whole[at : at + size], n)
        at += size + 1


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, bucket, seq (place in the bucket) and ids (16 bits each, the end id last) of every document."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = text_only(docs)
    n = partitions(spark)
    bounds = id_bounds(docs, n)
    dealt = docs.withColumn("bucket", id_bucket(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = array("H", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        seq = 0
        for batch in batches:
            ids = [enc.encode(x) + end for x in strings(batch, "text")]
            at = pa.array(np.arange(seq, seq + len(ids)), pa.int64())
            seq += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, pa.array(ids, pa.binary())], names=["doc_id", "bucket", "seq", "ids"])

    return dealt.mapInArrow(run, "doc_id long, bucket int, seq long, ids binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the whole table; the result has one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_files(tokens: DataFrame, by_rank: np.ndarray, path: str) -> None:
    """Write the token files; by_rank lists the ids from the commonest down."""
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = tokens.sparkSession.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        docs: list = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0
        last: tuple = ()

        def close() -> pa.RecordBatch:
            x = frame(docs, counts, ranks[np.frombuffer(b"".join(held), "<u2")])
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["frame"])

        for batch in batches:
            for doc_id, bucket, seq, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if docs and (total >= FRAME_IDS or last != (bucket, seq - 1)):  # a frame has neighbours only
                    yield close()
                    docs, counts, held, total = [], [], [], 0
                last = (bucket, seq)
                docs.append(doc_id)
                counts.append(len(ids) // 2)
                held.append(ids)
                total += len(ids) // 2
        if docs:
            yield close()

    frames_ = tokens.select("doc_id", "bucket", "seq", "ids").mapInArrow(run, "frame binary")
    frames_.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str, by_rank: np.ndarray) -> DataFrame:
    """One row a document: file, frame, place, doc_id, n_tokens, ids before it in its frame, ids_crc32."""
    shared = spark.sparkContext.broadcast(by_rank.astype("<u4"))
    schema = "file string, frame int, place int, doc_id long, n_tokens long, before long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (docs, counts, ranks) in enumerate(frames(content)):
                    ids = ids_of[ranks]
                    ends = np.cumsum(counts, dtype=np.int64)
                    starts = ends - counts
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    m = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * m, pa.string()), pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array(crc, pa.int64())],
                        names=["file", "frame", "place", "doc_id", "n_tokens", "before", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids as token files in ascending doc_id order and read them back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the
    end id) and ids_crc32. A null or empty text has the end id alone. Rows that
    share a doc_id follow each other, ordered by text; null ids come first. An
    empty table gives an empty result. The order of the files' frames is that of
    their first ids, so start needs the totals of frames alone.
    """
    spark = docs.sparkSession
    tokens = cut(tokenise(docs, tokenizer_path, end_id), "token-ids")
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    count = count_ids(tokens, size)
    by_rank = np.lexsort((np.arange(size), -count))
    path = shared_dir(spark, "token-files")
    write_files(tokens, by_rank, path)
    read = read_files(spark, path, by_rank)
    read = cut(read, "token-digest")
    totals = read.groupBy("file", "frame").agg(F.sum("n_tokens").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("low"), F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("high"))
    # frames of one task follow each other in its file; a file split between tasks keeps its order of ids
    offsets = running_total(totals, ["low", "high", "file", "frame"], "n").select("file", "frame", "offset")
    return read.join(offsets, ["file", "frame"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def running_total(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with offset, the sum of value over all rows before it in the given order.

    rows holds one row for some megabytes of tokens, so that even its order fits
    one task; it is small against the data.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(value).over(w), F.lit(0)))


def production(docs: DataFrame) -> DataFrame:
    return token_files(docs, public_tokenizers.path(WORD_49K))
