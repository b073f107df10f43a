"""Operator 2, quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are maximal runs of anything but space and \\x09-\\x0D. Each text becomes an array of word ids; n-grams of
several lengths get rolling hashes in numpy, and the code points inside n-grams seen earlier in the same text are
measured against those of all words. Every text is judged alone, so there is no shuffle.

Defined results: a null or empty text has no words and fails; repeated doc_ids are judged row by row; an empty table
gives no rows; other columns are left alone. A text of any length is read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table

SYMBOLS = b"#*$%&|<>"
#: For each n-gram length, the largest share of word characters inside n-grams that occurred before in the text.
#: A header repeated once as a footer of a short text stays below these.
COVERAGE = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The largest share of characters in lines that occurred before in the text.
LINE_COVERAGE = 0.30
MIN_WORDS = 50
BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_coverage double, ngram_coverage array<double>"
)


def later(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys seen before, and of keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    every = again.copy()
    every[order[:-1][same]] = True
    return again, every


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words that begins at a marked start."""
    edge = np.zeros(size + 1, np.int32)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge)[:size] > 0


def windows3(ids: np.ndarray, top: int) -> np.ndarray:
    """One exact key for each window of three ids below `top`."""
    if top <= 1 << 20:
        return (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * top + ids[2:]


def mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_coverage(ids: np.ndarray, chars: np.ndarray, lengths: tuple[int, ...]) -> list[float]:
    """For each length, the share of characters in words inside n-grams that occurred before."""
    out, total = [0.0] * len(lengths), max(1, int(chars.sum()))
    rolling, at = mixed(ids), 1
    word = rolling
    for k, n in enumerate(lengths):
        if len(ids) <= n:
            break
        while at < n:
            rolling = rolling[:-1] * BASE + word[at:]
            at += 1
        again, _ = later(rolling)
        if not again.any():
            break  # a longer n-gram can't repeat where no shorter one does
        out[k] = float(chars[covered(again, n, len(ids))].sum()) / total
    return out


def measure(text: str | None, ids: defaultdict[bytes, int], coverage: dict[int, float], line_coverage: float) -> tuple:
    """One text's figures and verdict. ids numbers the words of a block."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    own = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    lens = np.fromiter(map(len, words), np.int64, n)
    if len(raw) != len(text or ""):
        lens = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
    word_chars = int(lens.sum())
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = len if len(raw) == len(text or "") else lambda x: len(x.decode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    dup_chars = 0
    for x in lines:
        if x in seen:
            dup_chars += size(x)
        seen.add(x)
    line_share = dup_chars / max(1, sum(map(size, lines)))
    repeat, shares = 0, [0.0] * len(coverage)
    if n > 3:
        _, every = later(windows3(own, int(own.max()) + 1))
        if every.any():
            repeat = int(covered(every, 3, n).sum())
            shares = ngram_coverage(own, lens, tuple(coverage))
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    good = line_share <= line_coverage and all(s <= most for s, most in zip(shares, coverage.values(), strict=True))
    return n, word_chars, n_symbols, len(lines) - len(seen), repeat, failed, not failed and good, line_share, shares


#: Words that are numbered at once; numbers are compared within a text only, so texts get new ones beyond.
KNOWN = 1 << 17


def judged(batch: pa.RecordBatch, text: str, coverage: dict[int, float], line_coverage: float) -> list[tuple]:
    out, ids = [], defaultdict(count().__next__)
    for x in batch.column(batch.schema.get_field_index(text)).to_pylist():
        out.append(measure(x, ids, coverage, line_coverage))
        if len(ids) > KNOWN:
            ids = defaultdict(count().__next__)
    return out


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """Figures and verdict for each row: see RESULT. coverage must be in ascending order of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            rows = judged(b, text, coverage, line_coverage)
            own = pa.array([r[0] for r in rows], pa.int64())
            longs = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
            bools = [pa.array([r[i] for r in rows], pa.bool_()) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(key)).cast(pa.int64()), own, *longs, *bools, pa.array([r[7] for r in rows], pa.float64()), pa.array([r[8] for r in rows], pa.list_(pa.float64()))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_coverage", "ngram_coverage"],
            )

    return docs.select(key, text).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, text: str = "text", coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> DataFrame:
    """The rows of docs that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            yield b.filter(pa.array([r[6] for r in judged(b, text, coverage, line_coverage)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, line_coverage, and ngram_coverage, the largest of the shares."""
    return score(table(spark, sf_dir, "documents")).withColumn("ngram_coverage", F.array_max("ngram_coverage"))


#: The same by n-grams compared whole: words with their positions, each length's windows counted within their text.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
l AS (
  SELECT r, sum(length(line)) FILTER (again) / greatest(1, sum(length(line)))::DOUBLE AS line_coverage
  FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t))
  GROUP BY r),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
{{}}
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, (len(words) < {MIN_WORDS} OR 100 * coalesce(n_repeat, 0) > 50 * len(words)) AS base_failed,
  NOT base_failed AND coalesce(line_coverage, 0) <= {LINE_COVERAGE} AND {{}} AS kept, coalesce(line_coverage, 0)::DOUBLE AS line_coverage,
  greatest({{}}) AS ngram_coverage
FROM t LEFT JOIN l USING (r) LEFT JOIN n3 USING (r) {{}}
""".format(
    ",\n".join(
        f"g{n} AS (SELECT r, i, length(word) AS size, CASE WHEN lead(i, {n - 1}) OVER p IS NOT NULL THEN concat_ws(' ', word, {', '.join(f'lead(word, {k}) OVER p' for k in range(1, n))}) END AS gram FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),\n"
        f"a{n} AS (SELECT r, i, size, gram IS NOT NULL AND {'count(*) OVER (PARTITION BY r, gram)' if n == 3 else 'row_number() OVER (PARTITION BY r, gram ORDER BY i)'} > 1 AS again FROM g{n}),\n"
        f"c{n} AS (SELECT r, size, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM a{n}),\n"
        f"n{n} AS (SELECT r, count(*) FILTER (inside) AS n_repeat{'' if n == 3 else n}, coalesce(sum(size) FILTER (inside), 0) / greatest(1, sum(size))::DOUBLE AS share{n} FROM c{n} GROUP BY r)"
        for n in (3, *COVERAGE)
    ),
    " AND ".join(f"coalesce(share{n}, 0) <= {most}" for n, most in COVERAGE.items()),
    ", ".join(f"coalesce(share{n}, 0)::DOUBLE" for n in COVERAGE),
    " ".join(f"LEFT JOIN n{n} USING (r)" for n in COVERAGE),
)

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": SQL}
