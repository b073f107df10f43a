"""Operator 5, packing: documents as token ids into sequences of at most WINDOW tokens.

Each document's ids, ended by END, are cut into pieces of WINDOW tokens and a rest. Lengths count in units of GRAIN,
rounded up, so the histogram has WINDOW/GRAIN bins whatever the input. The combinations of one to three lengths that
fill a window are enumerated; non-negative least squares finds how often to repeat each so that together they use up
the histogram of all pieces. Pieces are dealt by hash into buckets of about BUCKET, and each bucket takes its share of those
counts, rounded down; what is left of it is packed greedily, longest first. Pieces carry their ids, compressed, through one
shuffle, and the row of a sequence's first piece holds the whole sequence (little-endian, four bytes each), padded with END to
WINDOW ids, except where its length is a power of two: such a sequence stays as it is.

Tokens are read once: pieces are written to the shared folder before they are counted and dealt. Buckets are dealt by a
number of the written row, so that neither a length nor a text that a third of all pieces have makes one larger.

Defined results: a null or empty text is the piece that holds END alone; repeated rows are packed as often as they
occur; an empty table gives no rows; of any length, a text is encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .bpe import numbers, planes
from .common import blocks, cut, table

WINDOW, GRAIN, END = 1024, 8, 0
UNITS = WINDOW // GRAIN
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PAD = np.array([END], "<u4").tobytes()
#: Pieces of a bucket, about, and bits of the numbers of its sequences.
BUCKET, OF_BUCKET = 8192, 24
RANKS_OF_ONE = np.int64(1) << 44  # more pieces than one length can have


def pieces(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, rank_file: str = tokens.RANKS, window: int = WINDOW) -> DataFrame:
    """PIECE rows, each document's in order; without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in blocks(batches, "text"):
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.vocabulary_ids(text, vocabulary, rank_file), np.uint32(END)).astype("<u4")
                out += [(key, i, len(x), zlib.crc32(x.tobytes()), len(ids), squeeze(planes(x))) for i in range(0, len(ids), window) for x in (ids[i : i + window],)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def combinations(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Of two to `depth` lengths, largest first, those that fill a window."""
    out = []
    for n in range(2, depth + 1):
        for x in combinations_with_replacement(range(1, units), n - 1):
            if (last := units - sum(x)) >= x[-1]:
                out.append((last, *reversed(x)))
    return out


def least_squares(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - h|: the active-set method. a has few rows, so the passive set stays small."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ h).max(initial=0))
    for _ in range(6 * m):
        gain = np.where(passive, -np.inf, a.T @ (h - a @ x))
        if gain.max() <= tolerance:
            break
        passive[gain.argmax()] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], h, rcond=None)[0]
            bad = passive & (s <= 1e-12)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x += step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Combinations of lengths that fill a window, with how often to repeat each so that they use the histogram up as well
    as can be; bin u counts pieces of u units, bin 0 is empty."""
    units = len(histogram) - 1
    present = set(np.flatnonzero(histogram[:units]).tolist())
    columns = [c for c in combinations(units) if present.issuperset(c)]
    if not columns:
        return []
    a = np.zeros((units, len(columns)))
    for j, c in enumerate(columns):
        for u in c:
            a[u, j] += 1
    return [(c, float(x)) for c, x in zip(columns, least_squares(a, histogram[:units].astype(float)), strict=True) if x > 0]


def plan(histogram: np.ndarray, wanted: list[tuple[tuple[int, ...], float]] | None = None, share: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each bin of the histogram up: a share of the wanted repeats, rounded down, then, of what
    is left, the longest that fit."""
    left = histogram.astype(np.int64).copy()
    units, out = len(left) - 1, []
    if left[units]:
        out.append(((units,), int(left[units])))
        left[units] = 0
    for c, x in repeats(histogram) if wanted is None else wanted:
        times = min(int(np.floor(x / share + 1e-9)), *(int(left[u]) // c.count(u) for u in c))
        if times > 0:
            out.append((c, times))
            for u in c:
                left[u] -= times
    while left.any():
        free, c = units, []
        now = left.copy()
        while len(fit := np.flatnonzero(now[: free + 1])):
            c.append(u := int(fit[-1]))
            now[u] -= 1
            free -= u
        times = min(int(left[u]) // c.count(u) for u in c)
        out.append((tuple(c), times))
        for u in c:
            left[u] -= times
    return out


def slots(steps: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place of the plan, in order: length and first rank as one number, first sequence, place within it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for c, times in steps:
        for place, u in enumerate(c):
            rows.append((u * int(RANKS_OF_ONE) + used.get(u, 0), sequence, place))
            used[u] = used.get(u, 0) + times
        sequence += times
    rows.sort()
    a = np.array(rows or [(0, 0, 0)], np.int64)
    return a[:, 0], a[:, 1], a[:, 2]


def pack(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, rank_file: str = tokens.RANKS) -> DataFrame:
    """PIECE columns but ids, with sequence_id, offset, and sequence: the ids of all its pieces and its padding, in the row of
    offset 0, null in others."""
    units = F.expr(f"(length + {GRAIN - 1}) div {GRAIN}")
    own = cut(pieces(docs, vocabulary, rank_file).withColumns({"units": units, "row": F.monotonically_increasing_id()}))
    histogram = np.zeros(UNITS + 1, np.int64)
    for u, n in own.groupBy("units").count().collect():  # at most UNITS rows
        histogram[u] = n
    wanted, buckets = repeats(histogram), max(1, -(-int(histogram.sum()) // BUCKET))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return sequenced(t, wanted, buckets, key[0].as_py())

    return own.groupBy(F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")).applyInArrow(run, f"{PIECE.removesuffix(', ids binary')}, sequence_id long, offset long, sequence binary")


def sequenced(t: pa.Table, wanted: list[tuple[tuple[int, ...], float]], buckets: int, bucket: int) -> pa.Table:
    """The pieces of one of the buckets, placed by its share of the wanted repeats, with their sequences."""
    t = t.sort_by([("units", "ascending"), ("row", "ascending")])
    units = t["units"].to_numpy()
    begin = np.searchsorted(units, units)  # of those of a length
    first, sequence, place = slots(plan(np.bincount(units, minlength=UNITS + 1), wanted, buckets))
    key = units * RANKS_OF_ONE + np.arange(len(units)) - begin
    i = np.searchsorted(first, key, "right") - 1
    number, at = sequence[i] + key - first[i], place[i]
    order = np.lexsort((at, number))
    t, number = t.take(pa.array(order)), number[order]
    length = t["length"].to_numpy()
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    n = np.diff(starts, append=len(number))
    before = np.cumsum(length) - length
    ids = [numbers(zstandard.decompress(x), size).tobytes() for x, size in zip(t["ids"].to_pylist(), length.tolist(), strict=True)]
    whole: list[bytes | None] = [None] * len(ids)
    for k, m, total in zip(starts.tolist(), n.tolist(), np.add.reduceat(length, starts).tolist(), strict=True):
        whole[k] = b"".join(ids[k : k + m]) + PAD * (0 if total & (total - 1) == 0 else WINDOW - total)
    own = number + (bucket << OF_BUCKET)
    names = [x.split()[0] for x in PIECE.split(", ")][:-1]
    return pa.table([*(t[x] for x in names), pa.array(own), pa.array(before - np.repeat(before[starts], n)), pa.array(whole, pa.binary())], [*names, "sequence_id", "offset", "sequence"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, and the tokens of their padded sequence in the row of its first one."""
    out = pack(table(spark, sf_dir, "documents"))
    return out.withColumn("sequence_tokens", F.expr("cast(octet_length(sequence) div 4 as bigint)")).drop("sequence")


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
