import math
import random

import duckdb

from copperleaf.llm import topk


def brute(rows, k=5):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in own:
        if i % 50 == 0:
            s = sorted((-sum(map(int.__mul__, q, x)), j) for j, x in own if j != i)[:k]
            out += [(i, n + 1, j, -t) for n, (t, j) in enumerate(s)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got(topk.op6_topk(spark, sf)) == sorted(con.sql(topk.SQL).fetchall())


def test_ties_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIECE", 16)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    rows += [(i, rows[3][1]) for i in range(160, 260)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] + [0.0] * 5), (450, [float("inf")] + [0.0] * 5), (500, [3e5] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cell int")
    assert got(topk.search(df)) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [x[2] for x in got(topk.search(df))] == [1, 2]
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.limit(1)).count() == 0
