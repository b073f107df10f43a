"""Record files read by byte ranges, whatever their size: no task holds a whole file.

A range is opened with pyarrow's file systems on the executors (another opener can be given) and owns the records that
begin in it. Fixed records begin at multiples of their length. Lines are split by Spark's text source. Variable ones (V,
VB) are a chain of descriptors, each of which says where the next is, so a range doesn't know where its first one lies.
It is worked out in three steps, each one job over all ranges:

1. For every place where a chain may enter a range (its first 64 KB, the longest record) the place where it enters the
   next one is found. Chains that meet go on as one; in a window that many enter all are advanced at once by pointer jumping.
2. From a file's begin on, its ranges are followed one after the other by looking up one number in each: a stream of small
   rows, one for each range.
3. Each range walks its own records, counts them, and, from the sums of those before it, numbers and returns them.

Files of one range need none of this; others are read three times (chains, counts, records).

Defined results: what a sequential reader gives. A descriptor of 4 or less is an empty record and left out; a record or
block that the file's end cuts ends the file, as do fewer than four bytes; a record that its block's end cuts is cut; an
empty file has no records, and no row of counts either (Spark lists none).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range; what a record may reach beyond it.
RANGE, OVER = 64 << 20, 1 << 16
#: Tasks of a scan at most; further ranges share them. Ranges that are small share a task of so many bytes, as long as that
#: leaves each core some tasks.
MOST_TASKS, SHARE, TASKS_OF_CORE = 1 << 17, 16 << 20, 4
#: As few chains as this are followed one by one.
FEW = 8
RECORD = "file string, line_num long, raw binary"
#: The place after a chain's end.
END = -1


def opened(path: str):
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(inner)


def part_of(path: str, begin: int, size: int, opener: Callable) -> bytes:
    with opener(path) as f:
        f.seek(begin)
        return f.read(size)


def sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, length of the files at a path; nothing of them is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def ranges(files: DataFrame, size: int) -> DataFrame:
    """file, length, number, begin of each range of files (file, length)."""
    every = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("number"))
    return every.withColumn("begin", F.col("number") * size)


def tasks_of(files: DataFrame, size: int) -> int:
    """How many tasks read the ranges of files (file, length); 0 without any."""
    n, total = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return min(int(n), max(-(-int(total) // SHARE), TASKS_OF_CORE * files.sparkSession.sparkContext.defaultParallelism))


def spread(rows: DataFrame, n: int) -> DataFrame:
    """Rows that stand for much work, dealt to as many tasks."""
    return rows.repartition(max(1, min(n, MOST_TASKS)), "file", "number")


def descriptors(data: bytes, at: int, size: int, final: int) -> Iterator[tuple[int, int]]:
    """Place and length of each descriptor of a chain from `at` on that lies before size; a last pair of where the chain is
    then and 0, or -1 and what is left of the file if it has ended. final: the file's end."""
    while at < size:
        if at + 4 > final:
            yield END, final - at
            return
        n = data[at] << 8 | data[at + 1]
        if n > 4 and at + n > final:
            yield END, final - at
            return
        yield at, n
        at += n if n > 4 else 4
    yield at, 0


def spans(data: bytes, at: int, size: int, final: int, in_blocks: bool) -> Iterator[tuple[int, int]]:
    """Begin and end of each record, of begin -1 for each empty one; at last -1 and -1 - what is left of a file that ends."""
    chain = descriptors(data, at, size, final)
    for at, n in chain:
        if at == END:
            yield -1, -1 - n
        elif n > 4 and in_blocks:
            k, end = at + 4, at + n
            while k + 4 <= end:
                m = data[k] << 8 | data[k + 1]
                yield (k + 4, min(k + m, end)) if m > 4 else (-1, 0)
                k += m if m > 4 else 4
        elif n > 4:
            yield at + 4, at + n
        elif at < size:
            yield -1, 0


def leaving(raw: np.ndarray, begin: int, end: int, final: int) -> np.ndarray:
    """For each place from begin to end, where a chain from there is when it has left that window, or END if the file ends
    before: all of them at once, by pointer jumping."""
    own = raw[begin : end + 1].astype(np.int32)
    own = np.pad(own, (0, end + 1 - begin - len(own)))
    n, place = own[:-1] << 8 | own[1:], np.arange(begin, end, dtype=np.int32)
    over = (place + 4 > final) | ((n > 4) & (place + n > final))
    place = np.where(over, np.int32(END), place + np.maximum(n, 4))
    inside = np.flatnonzero((place >= 0) & (place < end))
    while len(inside):
        place[inside] = place[place[inside] - begin]
        inside = inside[(place[inside] >= 0) & (place[inside] < end)]
    return place


def exits(data: bytes, size: int, final: int) -> np.ndarray:
    """For each of the first OVER places of a range, where a chain from there goes on in the next one (from its begin), or
    END if the file ends before."""
    raw, edge = np.frombuffer(data, np.uint8), min(OVER, size)
    place = np.arange(OVER, dtype=np.int32)
    place[:edge] = leaving(raw, 0, edge, final)
    heads, which = np.unique(place, return_inverse=True)
    while edge < size:
        begin, edge = edge, min(edge + OVER, size)
        todo = np.flatnonzero((heads >= 0) & (heads < edge))
        if len(todo) > FEW:
            heads[todo] = leaving(raw, begin, edge, final)[heads[todo] - begin]
        else:
            for i in todo.tolist():
                for at, _ in descriptors(data, int(heads[i]), edge, final):
                    pass
                heads[i] = at
        heads, inverse = np.unique(heads, return_inverse=True)
        which = inverse[which]
    return np.where(heads < 0, END, heads - size)[which].astype(np.int32)


def entered(every: DataFrame, n: int, size: int, opener: Callable = opened) -> DataFrame:
    """file, number, entry: where the chain of a file enters each of its ranges; ranges after its end have none."""

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, number, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = min(size, length - begin)
                found = exits(part_of(file, begin, own + OVER, opener), own, length - begin)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number]), pa.array([zstandard.compress(found.tobytes(), 3)], pa.binary())], ["file", "number", "exits"])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, entry = None, 0
        for b in batches:
            out = []
            for f, number, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f != file:
                    file, entry = f, 0
                if entry != END:
                    out.append((f, number, entry))
                    entry = int(np.frombuffer(zstandard.decompress(packed), np.int32)[entry])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "number", "entry"])

    maps = spread(every, n).select("file", "length", "number", "begin").mapInArrow(chains, "file string, number long, exits binary")
    return maps.repartition("file").sortWithinPartitions("file", "number").mapInArrow(followed, "file string, number long, entry long")


COUNTS = "file string, length long, number long, begin long, entry long, n long, n_empty long, tail long"


def counted(spark: SparkSession, path: str, in_blocks: bool, size: int, opener: Callable = opened) -> tuple[DataFrame, int]:
    """COUNTS of each range that its file's chain enters (records, empty records, bytes that no record has), and how many
    tasks read them."""
    files = sizes(spark, path)
    every = ranges(files, size)
    n = tasks_of(files, size)
    several = ranges(files.where(F.col("length") > size), size)
    entries = entered(several, n, size, opener)
    ones = every.where(F.col("length") <= size).withColumn("entry", F.lit(0).cast("long"))
    both = ones.unionByName(several.join(entries, ["file", "number"]).select(*ones.columns)) if n and not several.isEmpty() else ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file, length, _, begin, entry = row
                own = min(size, length - begin)
                records = empty = tail = 0
                for a, e in spans(part_of(file, begin, own + OVER, opener), entry, own, length - begin, in_blocks):
                    if a >= 0:
                        records += 1
                    elif e == 0:
                        empty += 1
                    else:
                        tail = -1 - e
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*row, records, empty, tail)], [x.split()[0] for x in COUNTS.split(", ")])

    return spread(both.select("file", "length", "number", "begin", "entry"), n).mapInArrow(run, COUNTS), n


def variable(spark: SparkSession, path: str, in_blocks: bool = False, size: int | None = None, opener: Callable = opened) -> DataFrame:
    """RECORD rows of the V or VB files at a path, numbered from 1 in each file."""
    size = size or RANGE
    own, n = counted(spark, path, in_blocks, size, opener)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, begin, entry, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = min(size, length - begin)
                data, rows, held = part_of(file, begin, own + OVER, opener), [], 0
                for a, e in spans(data, entry, own, length - begin, in_blocks):
                    if a >= 0:
                        rows.append(data[a:e])
                        held += e - a
                        if held > 4 << 20:
                            yield made(file, line, rows)
                            line, rows, held = line + len(rows), [], 0
                if rows:
                    yield made(file, line, rows)

    placed = spread(own.withColumn("line", before), n).select("file", "length", "begin", "entry", "line")
    return placed.mapInArrow(run, RECORD)


def made(file: str, before: int, rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(before + 1, before + len(rows) + 1), pa.int64()), pa.array(rows, pa.binary())], ["file", "line_num", "raw"])


def fixed(spark: SparkSession, path: str | list[str], record_length: int, size: int | None = None, opener: Callable = opened) -> DataFrame:
    """RECORD rows of fixed files that may have a short tail, which is left out."""
    step = max(1, (size or RANGE) // record_length) * record_length
    files = sizes(spark, path).withColumn("length", F.expr(f"length - length % {record_length}"))
    n = tasks_of(files, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = memoryview(part_of(file, begin, min(step, length - begin), opener))
                at_once = max(1, (4 << 20) // record_length) * record_length
                for a in range(0, len(data), at_once):
                    piece = data[a : a + at_once]
                    yield made(file, (begin + a) // record_length, [bytes(piece[k : k + record_length]) for k in range(0, len(piece), record_length)])

    return spread(ranges(files, step), n).select("file", "length", "begin").mapInArrow(run, RECORD)


def digests(spark: SparkSession, path: str, size: int | None = None, opener: Callable = opened) -> DataFrame:
    """number, raw: the SHA-256 of each range of each file at a path."""
    files, size = sizes(spark, path), size or RANGE
    n = tasks_of(files, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [hashlib.sha256(part_of(file, begin, size, opener)).digest() for file, begin in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.binary())], ["number", "raw"])

    return spread(ranges(files, size), n).select("file", "number", "begin").mapInArrow(run, "number long, raw binary")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of line-delimited files, without line ends (and without a byte order mark). Each split's lines are
    counted; the numbers of those before it in its file are added."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), place.alias("at"), F.col("value").cast("binary").alias("raw"))
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    bare = F.when(F.expr("endswith(raw, X'0D')"), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    return rows.join(placed, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line_num"), bare.alias("raw"))


def scan_counts(spark: SparkSession, path: str, recfm: str, record_length: int | None = None, skip: int = 0, size: int | None = None, opener: Callable = opened) -> DataFrame:
    """file, n_records, n_skipped, tail_bytes of each F, V or VB file: what a scan returns and what it passes over (headers, empty
    records, bytes at the end that are no record)."""
    files = sizes(spark, path)
    if recfm.upper() in ("F", "FB"):
        n = F.expr(f"length div {record_length}")
        return files.select("file", F.greatest(n - skip, F.lit(0)).alias("n_records"), F.least(n, F.lit(skip).cast("long")).alias("n_skipped"), F.expr(f"length % {record_length}").alias("tail_bytes"))
    own, _ = counted(spark, path, recfm.upper() == "VB", size or RANGE, opener)
    sums = own.groupBy("file").agg(F.sum("n").alias("n"), F.sum("n_empty").alias("empty"), F.sum("tail").alias("tail"))
    of = lambda c: F.coalesce(c, F.lit(0))
    return files.join(sums, "file", "left").select("file", of("n").alias("n_records"), of("empty").alias("n_skipped"), of("tail").alias("tail_bytes"))
