import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.operators import reconcile
from copperleaf.operators.decode import byte_histogram, guessed_page, page_ranking
from copperleaf.plans.catalog import PAGES, national


def test_sample_sizes():
    assert reconcile.sample_size(10**9, 0.95, 0.05) == 385
    assert reconcile.sample_size(10**9) == math.ceil(2.8070337683438042**2 / 4 / 1e-6 / (1 + (2.8070337683438042**2 / 4 / 1e-6 - 1) / 10**9))
    assert reconcile.sample_size(100) == 100 and reconcile.sample_size(0) == 0
    assert reconcile.sample_size(1000, 0.95, 0.05) == 278


@pytest.mark.parametrize("every", [0, 7, 40])
def test_the_interval_holds_planted_errors(spark, every):
    source = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    wrong = (F.col("k") % every == 0) if every else F.lit(False)
    target = source.withColumn("v", F.when(wrong, -1).otherwise(F.col("v"))).withColumn("k", F.col("k").cast("string"))  # another type of key
    [r] = reconcile.confidence_check(source, target, ["k"], 0.999, 0.02).collect()
    share = math.ceil(20000 / every) / 20000 if every else 0
    assert r.n_keys == 20000 and 4000 < r.n_sampled < 6500
    assert r.low <= share <= r.high and r.passed == (every == 0)


def test_missing_repeated_and_null_rows(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (3, "c"), (None, "n"), (4, "d")], "k long, v string")
    b = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (None, "n"), (4, "D"), (5, "e")], "k long, v string")
    [r] = reconcile.confidence_check(a, b, ["k"]).collect()
    assert (r.n_keys, r.n_sampled, r.n_different, r.passed) == (6, 6, 3, False)  # keys 3, 4 and 5
    [r] = reconcile.confidence_check(a.limit(0), b.limit(0), ["k"]).collect()
    assert (r.n_keys, r.n_sampled, r.rate, r.low, r.high, r.passed) == (0, 0, 0.0, 0.0, 0.0, True)


@pytest.mark.parametrize("page", PAGES)
def test_every_page_is_recognised(spark, page):
    """From bytes of its own letters among all 24: no other page makes the expected characters of them."""
    text = "An order of the name of some customer in a street " * 9 + national(page)
    place = {c: i for i, c in reversed(list(enumerate(codecs.code_page(page))))}
    counts = [0] * 256
    for c in text:
        counts[place[c]] += 1
    ranking = page_ranking(counts, PAGES, Counter(text))
    assert ranking[0][0] == page and ranking[1][1] < ranking[0][1]


def test_pages_that_agree_are_all_named(spark):
    rows = spark.createDataFrame([("PLAIN NAME 12".encode("cp037"),), (None,), (b"",)], "raw binary")
    best = guessed_page(rows, [*PAGES, "latin-1"])
    assert {"cp037", "cp1140", "cp273"} <= set(best) and "latin-1" not in best
    assert guessed_page(spark.createDataFrame([("Grün, Öl €".encode("cp1140"),)], "raw binary"), ["cp037", "cp1140"]) == ["cp1140"]


def test_histograms_by_group(spark):
    rows = spark.createDataFrame([("a", b"xxy"), ("b", b"x"), ("a", b"y")], "k string, raw binary")
    got = {r.k: (r.counts[ord("x")], r.counts[ord("y")], sum(r.counts)) for r in byte_histogram(rows, "k").collect()}
    assert got == {"a": (2, 2, 4), "b": (1, 0, 1)}
    assert byte_histogram(rows.limit(0)).first().counts == [0] * 256
