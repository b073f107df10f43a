import math
import random

import duckdb
import numpy as np
import pytest

from copperleaf.llm import negatives


def brute(rows, anchors=100, k=5):
    own = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, q in own:
        if i % anchors == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for j, m, v in own if j != i)  # noqa: B905  shorter vectors end in zeros
            for t, j, _ in [x for x in s if x[2] == l][:k]:
                window = [(n, -u) for u, n, m in s if m != l and 80 * -t <= 100 * -u <= 100 * -t][:k]
                out += [(i, j, r + 1, n, -t, u) for r, (n, u) in enumerate(window)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 64, 3), (33, 64, 70), (100, 100, 100), (65, 130, 257), (0, 4, 2), (40, 0, 40)])
def test_strassen(shape):
    rng = np.random.default_rng(3)
    m, k, n = shape
    for most in (10, 1 << 40):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        want = (a.astype(object) @ b.astype(object)) % (1 << 64) if k else np.zeros((m, n), object)
        for leaf in (4, 32):
            assert ((negatives.strassen(a, b, leaf).astype(object) % (1 << 64)) == want).all()


def test_large_numbers_saturate():
    a = np.array([[2**62, -(2**62)], [1, 2]])
    assert negatives.scores(a, a).tolist() == [[2**63 - 1, -(2**62)], [-(2**62), 5]]


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(negatives.SQL)
    df = negatives.op12_hard_negatives(spark, sf)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert got(df) == sorted(want.fetchall())


def test_ties_copies_nulls_and_tiles(spark, monkeypatch):
    for name, size in (("ANCHORS", 3), ("CANDIDATES", 20), ("STRIP", 7), ("LEAF", 2)):
        monkeypatch.setattr(negatives, name, size)
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 1, 1, 2]), [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(5)]) for i in range(160)]
    rows += [(i, 1, rows[10][2]) for i in range(160, 230)]
    rows += [(301, None, [1.0] * 5), (302, 1, None), (303, 1, [1.0, None, 0.0, 0.0, 0.0]), (304, 1, [float("nan")] * 5), (300, 1, [float("inf")] * 5), (None, 1, [1.0] * 5)]
    rows += [(310, 1, []), (312, 2, [1.0]), (320, 0, [1.0, 1.0, 1.0, 1.0, 1.0, 2.0]), (400, 77, [1.0] * 5)]
    df = spark.createDataFrame([(*x, 1, "n") for x in rows], "vec_id long, label int, embedding array<double>, row int, found string")
    assert got(negatives.mined(df, "vec_id % 10 = 0")) == brute(rows, 10)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 0.0]), (2, 2, [0.9, 0.0])]
    rows += [(100, 4, [3e13, 1.0]), (101, 4, [1.0, 2.0]), (102, 5, [1.0, 1.0]), (103, 5, [0.99, 1.0])]  # products of more than 53 bits
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(negatives.mined(df)) == brute(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [-1.0])], "vec_id long, label int, embedding array<float>")
    assert got(negatives.mined(df)) == []  # no score in the window
    assert got(negatives.mined(df.limit(0))) == []
    assert got(negatives.mined(df.where("vec_id > 0"))) == []
