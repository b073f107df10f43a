"""Operator 8, suffix-array dedup: passages of LEAST words or more that repeat across documents.

The suffix array is sparse: of all suffixes (from a word to the end of its document) only those at minimiser positions
are kept, where an 8-word window has the smallest hash among WINDOW windows in a row. So a passage that repeats keeps
the same positions everywhere, and the first of them leaves SAME words of a passage of LEAST. Suffixes are sorted by
the hash of their first SAME words, then by the words after those, then by the words before; neighbours in that order, of
different documents, are compared, and their match is extended word by word to the right and to the left. Matches of
LEAST words or more are spans; spans of a document that touch are united, so longer passages are covered from position
to position.

The order knows the words to the right best. A passage that needs words to its left may have other documents between its
two holders, so all suffixes of a key are also compared in windows: every LEAST words around a kept position, by hash.
Suffixes are dealt by key and read as a stream, a key at a time; keys of more than HOT suffixes, as a passage makes them
that a third of all documents hold, are instead sorted by range over all tasks, spread by the words around them. There
neighbours across a range's border meet afterwards (of each range, the first and the last run of suffixes of one
document), and windows are grouped by Spark.

Suffixes whose first words occur once are left out before the sort, by counts over all documents: in the tasks that make
them by a bitmap, as long as their number allows one, otherwise by a join with the counts.

Words are maximal runs of anything but space and \\x09-\\x0D, compared by hash (64 bits for the first SAME, 32 for each
word after). Defined results: null, empty and short texts have no spans, rows without doc_id take no part; a repeat within
one doc_id alone is none; rows of one doc_id with other texts have spans of their own, known by the text's hash; an empty table gives no rows; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Marks, blocks, cut, parted, partitions, repeated, table, tallied, text_hash
from .jaccard import WordHashes, mixed

LEAST, WINDOW, SAME = 50, 19, 32
AROUND = LEAST - SAME  # words on either side that can make a match long enough
#: Keys of more suffixes are sorted over all tasks.
HOT = 1 << 14
MIX = np.uint64(0x9E3779B97F4A7C15)
SUFFIX = "key long, after binary, doc_id long, at int, before binary, n_before int, n_after int, h long"
ORDER = ("key", "after", "before", "doc_id", "at")
SPAN = "doc_id long, start long, end long, partner long, text_hash long"


def suffixes(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions in the words of a block, the hash of their first SAME words, and their documents' numbers."""
    empty = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) < SAME:
        return empty
    h, width, eight = words, 1, None
    while width < SAME:
        h = h[:-width] * (MIX + np.uint64(2 * width)) + h[width:]
        width *= 2
        if width == 8:
            eight = mixed(h)
    if len(eight) < WINDOW:
        return empty
    lowest = np.lib.stride_tricks.sliding_window_view(eight, WINDOW).argmin(1) + np.arange(len(eight) - WINDOW + 1)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    inside = doc[: len(lowest)] == doc[np.arange(len(lowest)) + WINDOW + 6]
    at = np.unique(lowest[inside])
    at = at[at + SAME <= begin[doc[at] + 1]]
    return at, mixed(h[at]), doc[at]


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Blocks, their word hashes and each document's first word; documents shorter than LEAST have no words."""
    for b in blocks(batches, "text"):
        known, parts = WordHashes(), []
        for text in b.column(1).to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").split()
            parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) if len(words) >= LEAST else np.empty(0, np.uint64))
        yield b, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def kept_suffixes(docs: DataFrame) -> DataFrame:
    """SUFFIX rows whose first words occur twice or more, with hot: whether they occur more than HOT times (if many keys
    do, some others may be taken for hot)."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tallied(suffixes(words, begin)[1] for _, words, begin in words_of(batches))

    counts = repeated(own.mapInArrow(keys, "key long, n long"))
    twice, hot = Marks(counts.select("key")), Marks(cut(counts.where(F.col("n") > HOT).select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words, begin in words_of(batches):
            at, key, doc = suffixes(words, begin)
            m = twice.of(key)
            at, key, doc = at[m], key[m], doc[m]
            if not len(at):
                continue
            short = np.concatenate([np.zeros(AROUND, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(AROUND, np.uint32)])
            steps = np.arange(AROUND)
            after = short[AROUND + at[:, None] + SAME + steps]
            before = short[AROUND + at[:, None] - 1 - steps]
            raw = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AROUND), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            hashes = np.fromiter(map(text_hash, b.column(1).to_pylist()), np.int64, b.num_rows)
            n_before, n_after = np.minimum(at - begin[doc], AROUND), np.minimum(begin[doc + 1] - at - SAME, AROUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), raw(after), b.column(0).take(pa.array(doc)), pa.array((at - begin[doc]).astype(np.int32)), raw(before), pa.array(n_before.astype(np.int32)), pa.array(n_after.astype(np.int32)), pa.array(hashes[doc]), pa.array(hot.of(key))],
                [*(x.split()[0] for x in SUFFIX.split(", ")), "hot"],
            )

    out = own.mapInArrow(run, f"{SUFFIX}, hot boolean")
    return out if twice.sent else out.join(counts.select("key"), "key", "left_semi")


def equal_run(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many values each two rows begin with in common, `most` at most."""
    same = np.concatenate([x == y, np.zeros((len(x), 1), bool)], axis=1)
    return np.minimum(same.argmin(1), most)


def columns_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    """key, doc_id, at, n_before, n_after; after and before as rows of AROUND words."""
    words = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint32).reshape(-1, AROUND) for c in ("after", "before"))
    return *(t[c].to_numpy().astype(np.int64) for c in ("key", "doc_id", "at", "n_before", "n_after")), *words


def neighbours(t: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """For the nearest suffixes before and after each one of the sorted table, of another document and the same key: rows
    of t, start, end and partner of the matches of LEAST words or more."""
    key, doc, at, n_before, n_after, after, before = columns_of(t)
    n = len(key)
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    runs = np.append(np.flatnonzero(new), n)
    stop = runs[np.searchsorted(runs, np.arange(n), "right")]
    out = []
    for other in (begin - 1, stop):
        i = np.flatnonzero((other >= 0) & (other < n))
        j = other[i]
        fine = key[i] == key[j]
        i, j = i[fine], j[fine]
        right = equal_run(after[i], after[j], np.minimum(n_after[i], n_after[j]))
        left = equal_run(before[i], before[j], np.minimum(n_before[i], n_before[j]))
        long = left + right + SAME >= LEAST
        i, j, left, right = i[long], j[long], left[long], right[long]
        out.append((i, at[i] - left, at[i] + SAME + right, doc[j]))
    return out


def spans_of(t: pa.Table, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """SPAN rows of matches (row of t, start, end, partner)."""
    i, start, end, partner = (np.concatenate([x[c] for x in found]) for c in range(4))
    return pa.RecordBatch.from_arrays([pa.array(t["doc_id"].to_numpy()[i]), pa.array(start), pa.array(end), pa.array(partner), pa.array(t["h"].to_numpy()[i])], ["doc_id", "start", "end", "partner", "text_hash"])


def matches(t: pa.Table) -> pa.RecordBatch:
    return spans_of(t, neighbours(t))


def around(t: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """Matches by windows of LEAST words around suffixes, of whole keys: rows of t, start, end and partner. A row's windows
    that smaller documents hold are one match, and so are those that only larger ones hold."""
    key, doc, at, n_before, n_after, after, before = columns_of(t)
    left, right = (np.empty((len(key), AROUND + 1), np.uint64) for _ in range(2))
    for hashes, words in ((left, before), (right, after)):
        hashes[:, 0] = 1
        for l in range(AROUND):
            hashes[:, l + 1] = mixed(hashes[:, l] * MIX + words[:, l])
    steps = np.arange(AROUND + 1)
    group = mixed((left * MIX + right[:, ::-1]) * MIX + (key.view(np.uint64)[:, None] ^ steps.astype(np.uint64)))
    fine = (steps <= n_before[:, None]) & (AROUND - steps <= n_after[:, None])
    row, l = np.nonzero(fine)
    flat = group[fine]
    order = np.argsort(flat, kind="stable")
    flat, by = flat[order], doc[row[order]]
    edges = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    size = np.diff(np.append(edges, len(flat)))
    lo, hi = (np.repeat(f.reduceat(by, edges), size) if len(flat) else by for f in (np.minimum, np.maximum))
    out = []
    for held, partner in ((lo < by, lo), ((lo == by) & (hi > by), hi)):
        n = np.where(held)[0]
        i, at_l = row[order[n]], l[order[n]]
        first, last = np.full(len(key), AROUND + 1), np.full(len(key), -1)
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(first, i, at_l)
        np.maximum.at(last, i, at_l)
        np.minimum.at(least, i, partner[n])
        own = np.flatnonzero(last >= 0)
        out.append((own, at[own] - last[own], at[own] - first[own] + LEAST, least[own]))
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """SPAN rows of suffixes whose keys hold HOT of them at most: neighbours' matches, and windows that these don't cover."""

    def found(t: pa.Table) -> pa.RecordBatch:
        doc = t["doc_id"].to_numpy()
        near, wide = neighbours(t), around(t)
        out = list(near)
        for i, start, end, partner in wide:
            new = np.ones(len(i), bool)
            for k, s, e, p in near:
                first, last = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
                same = p < doc[k] if len(i) and partner[0] < doc[i[0]] else p > doc[k]
                first[k[same]], last[k[same]] = s[same], e[same]
                new &= (first[i] > start) | (last[i] < end)
            out.append((i[new], start[new], end[new], partner[new]))
        return spans_of(t, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = t["key"].to_numpy()
            whole = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])  # the last key may go on
            if whole:
                yield found(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None:
            yield found(held)

    return rows.repartition(2 * partitions(rows.sparkSession), "key").sortWithinPartitions(*ORDER).mapInArrow(run, SPAN)


def compared(rows: DataFrame) -> DataFrame:
    """SPAN rows of neighbours in the order of the suffix array."""
    columns = [x.split()[0] for x in SUFFIX.split(", ")]
    given = ["doc" if c == "doc_id" else c for c in columns]
    names = [x.split()[0] for x in SPAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SPAN rows; and the first and the last run of one document and key, to be compared across borders: those rows
        have the suffix columns only."""
        held, first = None, None

        def edge(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(t.num_rows, pa.int64()) for _ in names), *(t[c].combine_chunks() for c in columns)], [*names, *given])

        def same(t: pa.Table, run: tuple) -> np.ndarray:
            return (t["doc_id"].to_numpy() == run[0]) & (t["key"].to_numpy() == run[1])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is None:
                first = (t["doc_id"][0].as_py(), t["key"][0].as_py())
            if first is not None:
                n = int(np.argmin(np.append(same(t, first), False)))
                yield edge(t.slice(0, n))
                first = first if n == t.num_rows else None
            t = t if held is None else pa.concat_tables([held, t])
            found = matches(t)
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, f.type) for f in b.schema)], [*names, *given])
            # the last run and one row of the run before it are seen again with what follows
            other = np.flatnonzero(~same(t, (t["doc_id"][-1].as_py(), t["key"][-1].as_py())))
            held = t.slice(int(other[-1]) if len(other) else 0)
        if held is not None and first is None:
            yield edge(held.filter(pa.array(same(held, (held["doc_id"][-1].as_py(), held["key"][-1].as_py())))))

    n = 2 * partitions(rows.sparkSession)
    both = cut(rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, f"{SPAN}, {SUFFIX.replace('doc_id', 'doc')}"))
    spans = both.where("partner is not null").select(*names)
    edges = both.where("partner is null").select("key", "after", F.col("doc").alias("doc_id"), "at", "before", "n_before", "n_after", "h")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = [b for b in batches if b.num_rows]
        if t:
            yield matches(pa.Table.from_batches(t))

    # two runs of each range, a run being part of one document, so one task is enough
    return spans.unionAll(edges.coalesce(1).sortWithinPartitions(*ORDER).mapInArrow(borders, SPAN))


def windows(rows: DataFrame) -> DataFrame:
    """SPAN rows of LEAST words around suffixes whose neighbours may hide a match: of keys of three suffixes or more
    that go on differently. Each suffix meets those with the same l words before and AROUND - l after, for each l."""
    some = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("after")).alias("a"), F.max(F.xxhash64("after")).alias("z"), F.min("n_after").alias("least"))
    own = rows.join(some.where(f"n > 2 and (a <> z or least < {AROUND})").select("key"), "key").where(f"n_before + n_after >= {AROUND}")
    own = own.withColumn("l", F.expr(f"explode(sequence({AROUND} - n_after, n_before))"))
    group = F.expr(f"xxhash64(key, l, substring(before, 1, 4 * l), substring(after, 1, 4 * ({AROUND} - l)))")
    met = own.select(group.alias("g"), "doc_id", (F.col("at") - F.col("l")).cast("long").alias("start"), "h")
    # written, so that a window that very many documents hold can be split in the join
    holders = cut(met.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi"))
    partner = F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return met.join(holders, "g").select("doc_id", "start", (F.col("start") + LEAST).alias("end"), partner.alias("partner"), F.col("h").alias("text_hash"))


def united(found: DataFrame) -> DataFrame:
    """SPAN rows of a document that touch, as one with the smallest partner."""
    w = Window.partitionBy("doc_id", "text_hash").orderBy("start")  # a document's own spans
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach") >= F.col("start"), 0).otherwise(1)).over(w)
    out = found.groupBy("doc_id", "text_hash", "start").agg(F.max("end").alias("end"), F.min("partner").alias("partner")).withColumn("reach", reach).withColumn("island", island)
    return out.groupBy("doc_id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("partner")).select(*(x.split()[0] for x in SPAN.split(", ")))


def matched(docs: DataFrame) -> DataFrame:
    """SPAN rows, one for each match: documents with a smaller doc_id hold all its words if the partner is smaller."""
    rows = cut(kept_suffixes(docs))
    hot = rows.where("hot").drop("hot")
    return dealt(rows.where("not hot").drop("hot")).unionAll(compared(hot)).unionAll(windows(hot))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words, end exclusive), partner (another document that holds part of the span, the smallest one met),
    text_hash (of the row's text, which tells it from other rows of its doc_id)."""
    return united(matched(docs))


def without_repeats(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id and text of every row, matches taken out of the larger of two doc_ids; words are joined by one space there.

    found: rows of matched(). Only words that a smaller doc_id holds go, so the smallest holder of a passage keeps it."""
    found = matched(docs) if found is None else found
    gone = cut(united(found.where("partner < doc_id")).groupBy("doc_id", F.col("text_hash").alias("__h")).agg(F.collect_list(F.struct("start", "end")).alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, away in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if away:
                    words = text.encode("utf-8", "surrogatepass").split()
                    for x in sorted(away, key=lambda x: -x["start"]):
                        del words[x["start"] : x["end"]]
                    text = b" ".join(words).decode("utf-8", "surrogatepass")
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    others, concerned = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gone.select("__h"))
    return others.unionAll(concerned.join(gone, ["doc_id", "__h"], "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, text string"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("partner").alias("partner_doc_id"), "text_hash")


QUERIES = {"op8_suffix_array": op8_suffix_array}
ORACLES: dict[str, str] = {}
