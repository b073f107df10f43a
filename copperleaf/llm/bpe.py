"""Operator 3, byte-level BPE encoding and decoding by one global shuffle of distinct words.

Texts are split into pre-tokens by the public pattern. A block of texts (BLOCK bytes at most, one longer text excepted)
numbers its distinct pre-tokens; each text keeps its pre-tokens' numbers in order, which are their positions. The
distinct pre-tokens are dealt by hash into buckets, once from each block, and every bucket encodes each of its distinct
pre-tokens once, whatever number of blocks has it. Their ids go back to the blocks, where each text is put together by
position. Decoding joins the token-byte table (one row for each id of the vocabulary, a proven bound).

Rows travel packed: one for each block and bucket with its pre-tokens sorted, and one for some thousand numbers of
texts, numbers dealt by falling frequency, both compressed. A third of
all texts may share a word: it then is one entry for each block, not one row for each occurrence.

docs is read twice and must give the same blocks, as a table or a written stage does; if not, the job fails. A block is
named by its place (partition and number there) and content, so blocks of equal content stay apart.

Defined results: a null or empty text has no ids; repeated rows are encoded row by row, equal doc_ids included; an
empty table gives no rows; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import blocks, partitions, table

#: Bytes of text in a block: the larger, the fewer times a pre-token is sent.
BLOCK = 24 << 20
#: Bucket rows: the pre-tokens of a block and bucket, later their ids. Text rows (bucket null): doc_ids, how many
#: pre-tokens each text has, and all their numbers.
PART = "block string, bucket int, keys array<long>, sizes array<int>, payload binary"
#: Distinct pre-tokens that a task remembers the ids of.
KNOWN = 1 << 20
#: Numbers in a text row, about.
ROW = 1 << 16
ENCODED = "doc_id long, n_tokens long, ids binary"


@lru_cache(maxsize=1)
def splitter(pattern: str):
    return regex.compile(pattern)


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table as columns: all bytes, and each id's first byte and length."""
    known = tokens.ranks(path)
    by_id = [b""] * (max(known.values()) + 1)
    for b, i in known.items():
        by_id[i] = b
    n = np.array([len(b) for b in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(n) - n, n


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: those of small numbers are mostly zeros and compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def packed(ranks: np.ndarray, words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return len(words).to_bytes(4, "little") + zstandard.compress(planes(ranks) + planes(sizes) + b"".join(words), 3)


def unpacked(payload: bytes) -> tuple[bytes, list[bytes]]:
    """The planes of the numbers, and the pre-tokens."""
    n, raw = int.from_bytes(payload[:4], "little"), zstandard.decompress(payload[4:])
    ends = np.cumsum(numbers(raw[4 * n :], n), dtype=np.int64).tolist()
    body = raw[8 * n :]
    return raw[: 4 * n], [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def gathered(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[first:first + n] of each entry, one after the other."""
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first, n)
    return values[at]


def split(docs: DataFrame, buckets: int, texts: bool, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """PART rows: the text rows of each block, or its bucket rows. A block is named by its content and numbers its
    distinct pre-tokens by falling frequency; text rows hold the numbers by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        for place, b in enumerate(blocks(batches, "text", BLOCK)):
            number: defaultdict[str, int] = defaultdict(count().__next__)
            keys, order = b.column(0).to_pylist(), []
            for text in b.column(1).to_pylist():
                words = find(text or "")
                order.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            times = np.bincount(np.concatenate(order), minlength=len(number))
            rank = np.empty(len(number), np.uint32)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(number))
            words, every = [w.encode("utf-8", "surrogatepass") for w in number], np.concatenate(order)
            content = xxhash.xxh3_128_hexdigest(b"\0".join(words) + every.tobytes() + np.array([len(x) for x in order]).tobytes())
            name = f"{b.column(2)[0].as_py()}-{place}-{content}"
            out = []
            if texts:
                begin = size = 0
                for i in range(len(order) + 1):
                    if i == len(order) or size > ROW:
                        own = order[begin:i]
                        out.append((name, None, keys[begin:i], [len(x) for x in own], zstandard.compress(planes(rank[np.concatenate(own)]), 3)))
                        begin, size = i, 0
                    if i < len(order):
                        size += len(order[i])
            else:
                held: list[list[int]] = [[] for _ in range(buckets)]
                for i, w in enumerate(words):
                    held[zlib.crc32(w) % buckets].append(i)
                for k, own in enumerate(held):
                    if own:
                        own.sort(key=words.__getitem__)
                        out.append((name, k, None, None, packed(rank[own], [words[i] for i in own])))
            if not out:
                continue
            types = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "bucket", "keys", "sizes", "payload"])

    # the partition of docs itself, whatever union the rows become part of
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInArrow(run, PART)


def answered(parts: DataFrame, buckets: int, rank_file: str = tokens.RANKS) -> DataFrame:
    """Bucket rows with the ids of each pre-token instead of its bytes. Rows are read as a stream, a bucket after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, last = tokens.rank_encoding(rank_file).encode_ordinary, {}, None
        for b in batches:
            out = []
            for bucket, payload in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                if bucket != last or len(known) > KNOWN:
                    known, last = {}, bucket
                ranks, words = unpacked(payload)
                ids = []
                for w in words:
                    if (x := known.get(w)) is None:
                        x = known[w] = encode(w.decode("utf-8", "surrogatepass"))
                    ids.append(x)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.array([i for x in ids for i in x], np.uint32)
                out.append(payload[:4] + zstandard.compress(ranks + planes(sizes) + planes(flat), 3))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], b.schema.names)

    return parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, PART)


def encode(docs: DataFrame, buckets: int | None = None, rank_file: str = tokens.RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """ENCODED: each text's ids, little-endian unsigned 32-bit numbers one after the other."""
    return assembled(docs, lambda key, ids: (key, len(ids), ids.tobytes()), ENCODED, buckets, rank_file, pattern)


def assembled(docs: DataFrame, made, schema: str, buckets: int | None = None, rank_file: str = tokens.RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row of the schema for each text, made(doc_id, ids) on the executors."""
    buckets = buckets or 2 * partitions(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t[c].to_pylist() for c in ("bucket", "keys", "sizes", "payload")), strict=True))
        ranks, sizes, flat = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], [np.empty(0, "<u4")]
        for bucket, _, _, payload in rows:
            if bucket is not None:
                n, raw = int.from_bytes(payload[:4], "little"), zstandard.decompress(payload[4:])
                ranks.append(numbers(raw, n))
                sizes.append(numbers(raw[4 * n :], n))
                flat.append(numbers(raw[8 * n :], len(raw) // 4 - 2 * n))
        n, ids, rank = np.concatenate(sizes).astype(np.int64), np.concatenate(flat), np.concatenate(ranks)
        if not any(bucket is None for bucket, *_ in rows):
            raise ValueError("docs gave other blocks when it was read again")
        first = np.empty(len(n), np.int64)
        first[rank] = np.cumsum(n) - n
        n[rank] = n.copy()
        out = []
        for bucket, keys, own, payload in rows:
            if bucket is None:
                at = numbers(zstandard.decompress(payload), sum(own))
                begin = 0
                for key, size in zip(keys, own, strict=True):
                    x = at[begin : begin + size]
                    begin += size
                    out.append(made(key, gathered(ids, first[x], n[x])))
        return pa.Table.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    # texts are split twice, once for either kind of row: their numbers need not travel with the pre-tokens
    both = answered(split(docs, buckets, False, pattern), buckets, rank_file).unionAll(split(docs, buckets, True, pattern))
    return both.groupBy("block").applyInArrow(run, schema)


def decoded(ids: np.ndarray, rank_file: str = tokens.RANKS) -> bytes:
    """The bytes of ids, from the token-byte table."""
    every, first, n = byte_table(rank_file)
    return gathered(every, first[ids], n[ids]).tobytes()


def decode(encoded: DataFrame, rank_file: str = tokens.RANKS) -> DataFrame:
    """doc_id and text of ENCODED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decoded(np.frombuffer(x, "<u4"), rank_file).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def made(key: int, ids: np.ndarray) -> tuple:
        return key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded(ids, rank_file)).hexdigest()

    return assembled(table(spark, sf_dir, "documents"), made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rank_file=rank_file)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
