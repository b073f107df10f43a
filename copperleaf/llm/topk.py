"""Operator 6, exact top-k search by inner product over a pivot-distance index.

Components become floor(SCALE * x), so scores are integers. Every vector is keyed by its nearest of PIVOTS pivots and
its distance to it; distances of one pivot are cut into RINGS annuli. A cell (pivot, annulus) is summed up by its
count, its extreme distances and its largest norm: MOST_PIVOTS * RINGS rows at most, whatever the input, so that table
alone is held by every task. Pivots grow with the fourth root of the vectors, from PIVOTS on. From the triangle inequality, |q - x| >= | |q - p| - |x - p| | for all x of a cell, and
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, together with q.x <= q.p + |q| |x - p|, bound each cell's scores for a query.

A query expands its cells in the order of their bounds: first as many as hold k other vectors, whose k-th best score
is a floor; then those whose bound reaches it; the others cannot matter. Cells are worked on in blocks: a cell's
vectors are salted into pieces of about PIECE vectors and the queries that expand it into groups of as many, so no task
ever holds a whole cell, and a cell that a third of all vectors lie in (copies of one) is spread. Vectors of cells that no
query expands stay where they are. Of each block only the k best of each query leave the task.

Pivots are chosen (farthest first) from the PIVOT_ROWS vectors of smallest hash, a bound independent of the input.
They steer the work only: results are exact.

Defined results: vectors that are null, of another length than most, or hold null or non-finite components take no
part; repeated vec_ids are rows of their own and never candidates of their own id; fewer than k candidates give fewer
rows; equal scores go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, smallest, table

SCALE, TOP = 256, 5
PIVOTS, MOST_PIVOTS, RINGS, PIECE, PIVOT_ROWS = 16, 256, 8, 4096, 2048
#: Relative slack of bounds that are computed in floating point.
SLACK = 1e-9
#: Sums of products stay exact in 64-bit integers below this; larger vectors are multiplied as Python integers.
SAFE = 1 << 62


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of whole numbers as doubles) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0 and vec_id is not null")


def pivots(own: DataFrame, rows: int = PIVOT_ROWS, n: int = PIVOTS) -> np.ndarray:
    """n of the `rows` vectors of smallest hash, each the farthest from those before it."""
    sample = [r.v for r in smallest(own, rows, "vec_id", "v").select("v").collect()]
    if not sample:
        return np.empty((0, 0))
    width = pd.Series([len(v) for v in sample]).mode()[0]
    a = np.array([v for v in sample if len(v) == width])
    chosen, far = [0], ((a - a[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((a - a[chosen[-1]]) ** 2).sum(1))
    return a[chosen]


def distances(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (centres * centres).sum(1) - 2 * a @ centres.T))


def keyed(own: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, v, pivot, d, norm2: the key of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                d = distances(a, centres)
                p = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p]), pa.array((a * a).sum(1))], ["vec_id", "v", "pivot", "d", "norm2"])

    return own.where(F.size("v") == centres.shape[1]).select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, pivot int, d double, norm2 double")


def bounds(q: np.ndarray, centres: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
    """For each query and cell, a number that no score there exceeds."""
    d = distances(q, centres)[:, cells["pivot"]]
    norm2 = (q * q).sum(1)[:, None]
    apart = np.maximum(0, np.maximum(d - cells["far"], cells["near"] - d)) * (1 - SLACK)
    by_triangle = (norm2 + cells["norm2"] - apart**2) / 2
    by_ball = (q @ centres.T)[:, cells["pivot"]] + np.sqrt(norm2) * cells["far"]
    best = np.minimum(by_triangle, by_ball)
    return best + SLACK * (np.abs(best) + norm2 + cells["norm2"]) + 1e-6


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as float64 where these are exact, else as integers."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 1 << 53:
        return (q @ x.T).astype(np.int64)
    if most < SAFE:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.array([[int(a) for a in r] for r in q], object) @ np.array([[int(a) for a in r] for r in x], object).T


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ties to the smaller vec_id. Few rows a block have come here."""
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visited(index: DataFrame, asked: DataFrame, held: dict[int, int], k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: the k best of every (query, piece of a cell) of asked: query_row, query_id, v,
    cell (written by cut()). held: the number of vectors of each cell."""
    opened = {int(r.cell): -(-r.n // PIECE) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as cells
    of = lambda known: F.get(F.array(*[F.lit(known.get(c, 1)) for c in range(max([*held, 0]) + 1)]), F.col("cell"))
    n_pieces, n_groups = of({c: -(-n // PIECE) for c, n in held.items()}), of(opened)
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    data = index.where(F.col("cell").isin(list(opened))).select("cell", deal(n_pieces, "vec_id", "v").alias("piece"), every(n_groups).alias("grp"), "vec_id", "v")
    asks = asked.select("cell", every(n_pieces).alias("piece"), deal(n_groups, "query_row").alias("grp"), "query_row", "query_id", "v")

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(a) and len(q):
            ids, x = a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for i in range(0, len(q), 256):
                part = q.iloc[i : i + 256]
                s = products(np.stack(part["v"].to_numpy()), x)
                for row, own, line in zip(part["query_row"], part["query_id"], s, strict=True):
                    free = np.flatnonzero(ids != own)
                    top = free[np.argsort(-line[free], kind="stable")[:k]]
                    out["query_row"] += [row] * len(top)
                    out["query_id"] += [own] * len(top)
                    out["vec_id"] += ids[top].tolist()
                    out["score"] += line[top].tolist()
        return pd.DataFrame(out)

    by = ["cell", "piece", "grp"]
    return data.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, query: str = "vec_id % 50 = 0", k: int = TOP, n_pivots: int | None = None, rings: int = RINGS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the SQL condition picks, its k best other rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    own = quantized(vectors)
    centres = pivots(own, n=n_pivots or min(MOST_PIVOTS, max(PIVOTS, round(2 * own.count() ** 0.25))))
    if not centres.size:
        return spark.createDataFrame([], schema)
    index = keyed(own, centres)
    spread = {r.pivot: (r.lo, r.hi) for r in index.groupBy("pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()}  # a row for each pivot
    lo = F.array(*[F.lit(float(spread.get(p, (0, 0))[0])) for p in range(len(centres))])
    width = F.array(*[F.lit(max(1e-9, (spread[p][1] - spread[p][0]) / rings) if p in spread else 1.0) for p in range(len(centres))])
    ring = F.least(F.lit(rings - 1), F.greatest(F.lit(0), F.floor((F.col("d") - F.get(lo, F.col("pivot"))) / F.get(width, F.col("pivot"))))).cast("int")
    index = cut(index.withColumn("cell", F.col("pivot") * rings + ring))
    rows = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.first("pivot").alias("pivot"), F.min("d").alias("near"), F.max("d").alias("far"), F.max("norm2").alias("norm2")).collect()  # MOST_PIVOTS * RINGS rows
    cells = {k2: np.array([r[k2] for r in rows]) for k2 in ("cell", "n", "pivot", "near", "far", "norm2")}
    held = {int(r.cell): r.n for r in rows}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from opened(b, None)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from opened(b, b.column(3).to_pylist())

    def opened(b: pa.RecordBatch, floors: list | None) -> Iterator[pa.RecordBatch]:
        """The cells that each query visits: without floors, the first of its order that hold k + 1 rows; with them, those
        not visited whose bound reaches the floor (None: all of them)."""
        if not b.num_rows:
            return
        q = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
        bound = bounds(q, centres, cells)
        order = np.argsort(-bound, axis=1, kind="stable")
        sums = np.cumsum(cells["n"][order], axis=1)
        seen = np.concatenate([np.ones((len(q), 1), bool), sums[:, :-1] < k + 1], axis=1)
        if floors is not None:
            floor = np.array([-np.inf if f is None else f for f in floors])
            seen = ~seen & (np.take_along_axis(bound, order, 1) >= floor[:, None])
        at, which = np.nonzero(seen)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(cells["cell"][order[at, which]], pa.int32())], ["query_row", "query_id", "v", "cell"])

    schema_asked = "query_row long, query_id long, v array<double>, cell int"
    asked = cut(index.where(query).select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "v"))
    found = cut(best_of(visited(index, cut(asked.mapInArrow(first, schema_asked)), held, k), k).drop("rank"))
    floors = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    more = asked.join(floors, "query_row", "left").select("query_row", "query_id", "v", F.col("floor").cast("double"))
    both = found.unionAll(visited(index, cut(more.mapInArrow(rest, schema_asked)), held, k))
    return best_of(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op6_topk": op6_topk}
ORACLES = {"op6_topk": SQL}
