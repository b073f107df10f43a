"""Operator 10, line dedup: of lines that are equal or nearly so, one stays.

Lines are the \\n-split pieces of a text; those without a word are left alone. Two lines are alike when their sets of
SHINGLE-character shingles have a Jaccard similarity of LIKE or more; shorter lines only when equal. Signatures of
BANDS * ROWS MinHash values are banded (a pair at the threshold shares a band with probability 0.995). In each bucket,
sorted, every line meets the first one and the one before it. Candidates are verified by exact Jaccard similarity on the
lines' own text; verified links go through a distributed union-find. Buckets that still hold several components, as
lines made from one template do, are tested whole: lines of different components meet pair by pair, in buckets of more
than LARGE lines by blocks of bounded size, which give a spanning forest of their links. No pair of a bucket that could
link two components is left untested. Of each component the occurrence of smallest (doc_id, line number) stays.

What is shuffled: 64-bit hashes of lines and bands, and the text of lines that are candidates only. A bitmap of the
candidates' hashes keeps the text of the others out of that shuffle, as long as their number allows one; results are the
same without it. Buckets are streamed in sorted order, so a line that a third of all rows hold needs no memory. Lines
count as equal when two hashes of 64 bits are: should unequal lines share the first one, the second keeps them apart.

Defined results: a null or empty text has no lines and stays as it is, and so does a row without doc_id; rows of equal
doc_id and text are one document and treated alike, rows of equal doc_id and different texts stay apart; an empty table
gives no rows; other columns are kept by dedup(); lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, blocks, cut, discard, parted, partitions, table, text_hash
from .components import components
from .jaccard import forest

SHINGLE, LIKE, BANDS, ROWS = 8, 0.8, 10, 4
#: Code points that are hashed at once, so that work stays in a processor's cache.
PORTION = 1 << 17
SEEN = 1 << 20
#: Buckets of more lines are compared in blocks of about BLOCK lines.
LARGE, BLOCK = 64, 256

_seed = np.random.default_rng(20)
MULTIPLIERS = (_seed.integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint64) | 1).astype(np.uint32)
OFFSETS = _seed.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)


def worded(text: str | None) -> list[tuple[int, str]]:
    """Number and text of each line with a word."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] if text else []


def check_hash(text: str) -> int:
    """A second hash, which tells unequal texts of equal text_hash() apart."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n (line number), line and check (its hashes); and one row for each document, which has
    the number of its lines as n and no line. Rows without doc_id have that row only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, own = text_hash(text), worded(text)
                rows.append((key, h, len(own), None, None))
                if key is not None:
                    rows += [(key, h, i, text_hash(x), check_hash(x)) for i, x in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "h", "n", "line", "check"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h long, n long, line long, check long")


def signatures(lines: list[str]) -> np.ndarray:
    """BANDS 64-bit keys of each line; lines have SHINGLE characters at least."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = 1
    while width < SHINGLE:  # a power of two
        c = c[:-width] * (MIX + np.uint64(2 * width)) + c[width:]
        width *= 2
    c ^= c >> np.uint64(29)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    own = np.append((c >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    start = np.cumsum(n) - n
    edges = np.stack([start, start + n - SHINGLE + 1], 1).ravel()
    out = np.empty((BANDS, len(lines)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = (key ^ np.minimum.reduceat(own * MULTIPLIERS[k] + OFFSETS[k], edges)[::2]) * MIX
            key ^= key >> np.uint64(31)
        out[band] = key
    return out.view(np.int64)


def banded(docs: DataFrame) -> DataFrame:
    """band, line: the buckets of every line of SHINGLE characters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def made(lines: list[str], keys: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signatures(lines).ravel()), pa.array(np.tile(np.array(keys, np.int64), BANDS))], ["band", "line"])

        for b in blocks(batches, "text"):
            lines: list[str] = []
            keys: list[int] = []
            size = 0
            for text in b.column(0).to_pylist():
                for _, x in worded(text):
                    if len(x) >= SHINGLE and (k := text_hash(x)) not in seen:
                        seen.add(k)
                        lines.append(x)
                        keys.append(k)
                        size += len(x)
                        if size > PORTION:
                            yield made(lines, keys)
                            lines, keys, size = [], [], 0
                if len(seen) > SEEN:
                    seen.clear()
            if lines:
                yield made(lines, keys)

    return docs.select("text").mapInArrow(run, "band long, line long")


def candidates(bands: DataFrame) -> DataFrame:
    """a, b: each line of a bucket with the first and with the one before it; and, with a band and without b, a as a
    line of that bucket, for buckets of three lines or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band0 = first0 = last0 = None
        rank0 = 0
        for batch in batches:
            band, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(band):
                continue
            again = np.append(band0 == band[0] and last0 == line[0], (band[1:] == band[:-1]) & (line[1:] == line[:-1]))
            band, line = band[~again], line[~again]
            if not len(band):
                continue
            new, at = np.append(band0 != band[0], band[1:] != band[:-1]), np.arange(len(band))
            start = np.maximum.accumulate(np.where(new, at, 0))
            first, rank, before = line[start], at - start + 1, np.append(line[:1], line[:-1])
            if not new[0]:
                run0 = np.cumsum(new) == 0
                first, rank = np.where(run0, first0, first), np.where(run0, rank + rank0, rank)
                before[0] = last0
            met, third, more = rank > 1, rank == 3, rank >= 3
            a, b = np.concatenate([first[met], before[more]]), np.concatenate([line[met], line[more]])
            lines = np.concatenate([first[third], before[third], line[more]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.minimum(a, b), lines])),
                    pa.chunked_array([pa.array(np.maximum(a, b)), pa.nulls(len(lines), pa.int64())]).combine_chunks(),
                    pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(np.concatenate([band[third], band[third], band[more]]))]).combine_chunks(),
                ],
                ["a", "b", "band"],
            )
            band0, first0, last0, rank0 = band[-1], first[-1], line[-1], int(rank[-1])

    n = 2 * partitions(bands.sparkSession)
    return bands.repartition(n, "band").sortWithinPartitions("band", "line").mapInArrow(run, "a long, b long, band long").distinct()


def texts_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """line, text, check: once for each hash in lines (one column, written by cut())."""
    wanted = Marks(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in blocks(batches, "text"):
            found: dict[int, str] = {}
            for text in b.column(0).to_pylist():
                for _, x in worded(text):
                    found[text_hash(x)] = x
            keys = np.fromiter(found, np.int64, len(found))
            keys = [k for k in keys[wanted.of(keys)].tolist() if k not in seen]
            seen.update(keys)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([found[k] for k in keys], pa.string()), pa.array([check_hash(found[k]) for k in keys], pa.int64())], ["line", "text", "check"])

    every = docs.select("text").mapInArrow(run, "line long, text string, check long")
    return every.join(lines.toDF("line"), "line", "left_semi").groupBy("line").agg(F.min_by("text", "check").alias("text"), F.min("check").alias("check"))


def shingled(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct shingles of each line, sorted, one line after the other, and where each line begins (one
    entry more than lines). Equal numbers are equal shingles, compared whole. Lines have SHINGLE characters at least."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.zeros(int(c.max()) + 1, bool)
    present[c] = True
    here = (np.cumsum(present) - 1)[c]  # characters of these lines, numbered
    at = np.repeat(np.cumsum(n) - n, n - SHINGLE + 1) + np.arange(int((n - SHINGLE + 1).sum())) - np.repeat(np.cumsum(n - SHINGLE + 1) - (n - SHINGLE + 1), n - SHINGLE + 1)
    bits, width = int(here.max()).bit_length(), 1
    grams = here.astype(np.uint64)
    while width < SHINGLE:
        if bits * 2 > 64:  # too many kinds of characters: pairs of halves are numbered first
            grams = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
            bits = int(grams.max()).bit_length()
        grams = grams[:-width] << np.uint64(bits) | grams[width:]
        bits, width = bits * 2, width * 2
    values, number = np.unique(grams[at], return_inverse=True)
    own = np.unique(np.repeat(np.arange(len(lines)), n - SHINGLE + 1) * len(values) + number)
    return own % len(values), np.searchsorted(own, np.arange(len(lines) + 1) * len(values))


def shingles(x: str) -> set[str]:
    return {x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)}


def verified(pairs: DataFrame, texts: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs a, b whose lines are alike. Rows come by a, whose shingles are made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if a != last:
                    last, own = a, shingles(x)
                fine = len(y) - SHINGLE + 1 >= like * len(own)  # fewer can't be enough
                if fine:
                    other = shingles(y)
                    fine = len(own) >= like * len(other)
                if fine:
                    both = len(own & other)
                    fine = both / (len(own) + len(other) - both) >= like
                keep.append(fine)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    side = lambda k: texts.select(F.col("line").alias(k), F.col("text").alias(f"{k}_text"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def of_large_buckets(large: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """a, b: links that connect the lines of large buckets that are alike. large: band, line, size. Every two blocks of
    a bucket are compared in a task of their own; only the links of a spanning forest leave it."""
    parts = F.expr(f"cast((size - 1) div {BLOCK} + 1 as int)")
    own = large.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")).join(texts, "line")
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "line", "text")

    def run(t: pa.Table) -> pa.Table:
        shingle, begin = shingled(t["text"].to_pylist())
        sets = np.split(shingle, begin[1:-1])
        part, line = t["part"].to_numpy(), t["line"].to_numpy()
        left, right = (np.flatnonzero(part == t[k][0].as_py()) for k in "ij")
        found = np.array(forest(sets, left, right, lambda both, n: both / (n - both) >= like), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(line[found[:, 0]]), pa.array(line[found[:, 1]])], ["a", "b"])

    return met.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


def linked(docs: DataFrame, like: float) -> DataFrame:
    """node, check, root: lines that are linked with another one."""
    met = cut(candidates(banded(docs)))
    pairs = met.where("band is null").select("a", "b")
    texts = cut(texts_of(docs, cut(pairs.select("a").unionAll(pairs.select("b")).distinct())))
    links = cut(verified(pairs, texts, like))
    roots = cut(components(links))
    lines = met.where("band is not null").select("band", F.col("a").alias("line"))
    own = cut(lines.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line")))
    # buckets of one component are done
    several = own.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("band", "size")
    left = cut(own.join(several, "band"))
    discard(own)
    small = left.where(F.col("size") <= LARGE).drop("size")
    others = small.select("band", F.col("line").alias("l_line"), F.col("root").alias("l_root"))
    more = small.join(others, "band").where("line < l_line and root <> l_root").select(F.col("line").alias("a"), F.col("l_line").alias("b")).distinct()
    more = cut(more.join(pairs, ["a", "b"], "left_anti"))
    large = of_large_buckets(left.where(F.col("size") > LARGE), texts, like)
    new = cut(verified(more, texts, like).unionAll(large))
    discard(met, left, more)
    if not new.isEmpty():  # what is united already goes on as stars
        roots = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(new))
    return roots.join(texts.select(F.col("line").alias("node"), "check"), "node")


def classed(own: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, h, n of the lines in own (see occurrences()), with class and side: lines of equal class and side are alike.
    roots: line, check, root."""
    both = own.where("line is not null").join(roots, ["line", "check"], "left")
    return both.select("doc_id", "h", "n", F.coalesce("root", "line").alias("class"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("side"))


def judged(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, h, n_lines, lines (numbers of those that go, null where none does): one row for each of docs."""
    roots = cut(linked(docs, like).select(F.col("node").alias("line"), "check", "root"))
    own = cut(occurrences(docs))
    lines = cut(classed(own, roots))
    kept = lines.groupBy("class", "side").agg(F.min(F.struct("doc_id", "n", "h")).alias("kept"), F.count(F.lit(1)).alias("all")).where("all > 1").drop("all")
    # written, so that both sides of the join are shuffled for it and a class of many lines can be split
    gone = lines.join(cut(kept), ["class", "side"]).where("doc_id <> kept.doc_id or n <> kept.n or h <> kept.h")
    gone = gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("n")).alias("lines"))
    return own.where("line is null").select("doc_id", "h", F.col("n").alias("n_lines")).join(gone, ["doc_id", "h"], "left")


def dropped(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, h, lines (numbers of those that go), one row for each distinct document that loses any."""
    return judged(docs, like).where("lines is not null").select("doc_id", "h", "lines").dropDuplicates(["doc_id", "h"])


def dedup(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """docs without the lines that go; documents that keep no line with a word go as well.

    Only documents that may lose lines are shuffled; the bitmap tells which."""
    gone = cut(dropped(docs, like))
    at, schema = docs.columns.index("text"), docs.schema
    has_chars = "n_chars" in docs.columns

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            out, keep = [], []
            for text, lines in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if lines:
                    away = set(lines)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
                out.append(text)
                keep.append(not lines or bool(text.strip(" \t\n\x0b\x0c\r")))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(out, columns[at].type)
            if has_chars:
                k = b.schema.names.index("n_chars")
                columns[k] = pa.array([old if not lines else len(t) for old, lines, t in zip(columns[k].to_pylist(), b.column(b.num_columns - 1).to_pylist(), out, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    others, concerned = parted(docs, gone.select("h"))
    moved = concerned.withColumn("__id", F.col("doc_id").cast("long"))
    lost = gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("lines").alias("__lines"))
    changed = moved.join(lost, ["__id", "__h"], "left").select(*docs.columns, "__lines").mapInArrow(rewritten, schema)
    return others.unionAll(changed)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the dropped lines' numbers of every document."""
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("dropped"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES: dict[str, str] = {}
