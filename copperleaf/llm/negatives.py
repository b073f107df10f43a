"""Operator 12, hard-negative mining by Strassen products of integer tiles.

Components become floor(SCALE * x), so all scores are integers. Anchors are a stated query set and meet all other rows in
tiles: groups of at most about ANCHORS anchors and CANDIDATES candidates, dealt by hash. A tile's scores are one matrix
product by Strassen's recursion over 64-bit integers, padded with zeros to halves of equal size. Its sums and differences
are exact: they are taken modulo 2^64, and so is every score, which fits. Tiles whose scores might not fit are multiplied as
Python integers and saturate.

There are two rounds. In the first, anchors meet the rows of their label alone; each tile leaves a heap of the best
`k_positives` for each anchor. In the second, anchors that found positives meet the rows of other labels; each tile leaves a heap
of the best `k_negatives` for each anchor and positive among the scores in its window. Heaps merge by keeping the best of their
union, in the task over strips of candidates, then by Spark before and after the shuffle.

A label that a third of all rows have is many tiles; no task holds more than one of either group, about. The numbers of
rows and anchors of a label are a written table that rows are joined with, so Spark can split that join.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part; shorter
vectors count as padded with zeros; repeated vec_ids are rows of their own, as anchors and as candidates, and never
candidates of their own vec_id; equal scores go to the smaller vec_id; anchors without positives and positives with an
empty window give no rows, as does an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least LOW hundredths of the positive's, and at most all of it.
LOW = 80
ANCHORS, CANDIDATES, STRIP = 512, 8192, 1024
#: Sides of the tiles that are multiplied without a further recursion.
LEAF = 32
LIMIT = 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers, modulo 2^64. Sides are padded with zeros so that they can be halved until one is at most leaf."""
    sides = [*a.shape, b.shape[1]]
    depth = max(0, int(np.ceil(np.log2(max(1, min(sides)) / leaf))))
    m, k, n = (-(-s // (1 << depth)) << depth for s in sides)
    out = _product(np.pad(a, ((0, m - sides[0]), (0, k - sides[1]))), np.pad(b, ((0, k - sides[1]), (0, n - sides[2]))), depth)
    return out[: sides[0], : sides[2]]


def _product(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return np.einsum("ik,kj->ij", a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _product(a11 + a22, b11 + b22, depth - 1)
    p2 = _product(a21 + a22, b11, depth - 1)
    p3 = _product(a11, b12 - b22, depth - 1)
    p4 = _product(a22, b21 - b11, depth - 1)
    p5 = _product(a11 + a12, b22, depth - 1)
    p6 = _product(a21 - a11, b11 + b12, depth - 1)
    p7 = _product(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b. Where they may not fit they are Python integers first, then saturate."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] <= LIMIT:
        return strassen(a, np.ascontiguousarray(b.T))
    exact = a.astype(object) @ b.T.astype(object)
    return np.array([[max(-LIMIT, min(LIMIT, x)) for x in line] for line in exact], np.int64).reshape(exact.shape)


def matrix(vectors: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of numbers, padded with zeros to the longest."""
    column = vectors.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(there).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def best(found: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    """Merges heaps: the k rows of the best scores for each key, ties to the smaller id, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged(heap: tuple[np.ndarray, np.ndarray], s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a heap (scores, ids) and further ones."""
    s, ids = np.concatenate([heap[0], s]), np.concatenate([heap[1], ids])
    top = np.lexsort((ids, -s))[:k]
    return s[top], ids[top]


def strips(ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Scores of all q with a strip of candidates, the strip's ids, and its place."""
    for i in range(0, len(ids), STRIP):
        part = slice(i, i + STRIP)
        yield scores(q, x[part]), ids[part], part


def dealt(rows: int | Column, size: int) -> Column:
    """In how many groups so many rows go."""
    return F.greatest(F.lit(1), F.ceil((F.lit(rows) if isinstance(rows, int) else rows) / size)).cast("int")


def tiled(anchors: DataFrame, rows: DataFrame, run, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """run(candidates, anchors) of every tile: each side's rows have the numbers of groups of both, n_grp and n_piece."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    group = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    by = [*keys, "grp", "piece"]
    left = rows.select("*", every("n_grp").alias("grp"), group("n_piece").alias("piece")).drop("n_grp", "n_piece")
    right = anchors.select("*", group("n_grp").alias("grp"), every("n_piece").alias("piece")).drop("n_grp", "n_piece")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides may come from one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def positives(own: DataFrame, asked: str, k: int) -> DataFrame:
    """row, anchor_id, positive_id, positive_score: the k best other rows of the label for each anchor."""
    sizes = cut(own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(asked)).alias("n_asked")).where("n_asked > 0").select("label", dealt(F.col("n_asked"), ANCHORS).alias("n_grp"), dealt(F.col("n"), CANDIDATES).alias("n_piece")))

    def run(c: pa.Table, a: pa.Table) -> pa.Table:
        out = []
        if c.num_rows and a.num_rows:
            x = matrix(c["v"])
            q = matrix(a["v"], x.shape[1])
            x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
            own_ids = a["vec_id"].to_numpy()
            heaps = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
            for s, ids, _ in strips(c["vec_id"].to_numpy(), x, q):
                for i, (line, me) in enumerate(zip(s, own_ids, strict=True)):
                    there = np.flatnonzero(ids != me)
                    heaps[i] = merged(heaps[i], line[there], ids[there], k)
            out = [(row, me, int(j), int(t)) for row, me, heap in zip(a["row"].to_pylist(), own_ids.tolist(), heaps, strict=True) for t, j in zip(*heap, strict=True)]
        return table_of(out, ["row", "anchor_id", "positive_id", "positive_score"])

    found = tiled(own.where(asked).join(sizes, "label"), own.join(sizes, "label"), run, "row long, anchor_id long, positive_id long, positive_score long", ("label",))
    return best(found, ["row"], "positive_score", "positive_id", k).drop("rank")


def table_of(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def in_windows(line: np.ndarray, ids: np.ndarray, wanted: list[int], heaps: list, low: int, k: int) -> None:
    """Merges one anchor's scores, best first with ties by id, into the heap of each of its positives."""
    order = np.lexsort((ids, -line))
    line, ids = line[order], ids[order]
    falling = -line
    for j, p in enumerate(wanted):
        least = -(-low * p // 100)  # 100 * score >= low * p
        a, b = (int(np.searchsorted(falling, -t, side=side)) for t, side in ((p, "left"), (least, "right")))
        if a < b:
            heaps[j] = merged(heaps[j], line[a : min(b, a + k)], ids[a : min(b, a + k)], k)


def mined(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor (rows of vec_id, label and
    embedding that the SQL condition picks) and each of its positives."""
    own = cut(quantized(vectors).withColumn("row", F.monotonically_increasing_id()))
    found = cut(positives(own, anchors, k_positives).select(*(F.col(c) for c in ("row", "positive_id", "positive_score")), F.monotonically_increasing_id().alias("pair")))
    asked = cut(own.where(anchors).join(found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pair", "positive_score"))).alias("found")), "row"))  # k_positives an anchor at most
    numbers = dict(n_grp=dealt(asked.count(), ANCHORS), n_piece=dealt(own.count(), CANDIDATES))

    def run(c: pa.Table, a: pa.Table) -> pa.Table:
        out = []
        if c.num_rows and a.num_rows:
            x = matrix(c["v"])
            q = matrix(a["v"], x.shape[1])
            x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
            labels, own_labels, pairs = c["label"].to_numpy(), a["label"].to_numpy(), a["found"].to_pylist()
            heaps = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in p] for p in pairs]
            for s, ids, part in strips(c["vec_id"].to_numpy(), x, q):
                for i, line in enumerate(s):
                    other = np.flatnonzero(labels[part] != own_labels[i])
                    in_windows(line[other], ids[other], [p["positive_score"] for p in pairs[i]], heaps[i], low, k_negatives)
            out = [(p["pair"], int(j), int(t)) for own_pairs, own_heaps in zip(pairs, heaps, strict=True) for p, heap in zip(own_pairs, own_heaps, strict=True) for t, j in zip(*heap, strict=True)]
        return table_of(out, ["pair", "negative_id", "negative_score"])

    negatives = best(tiled(asked.select("row", "label", "v", "found").withColumns(numbers), own.withColumns(numbers), run, "pair long, negative_id long, negative_score long"), ["pair"], "negative_score", "negative_id", k_negatives)
    named = found.join(own.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return negatives.join(named, "pair").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", noisy.alias("label"), "embedding"))


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS alike, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
  FROM e a JOIN e x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {"op12_hard_negatives": SQL}
