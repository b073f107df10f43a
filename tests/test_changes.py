import os

import pytest

from copperleaf.streaming.changes import ChangeTable

SCHEMA = "k long, pos long, op string, v string"


def started(spark, tmp_path, rows=((1, "a"), (2, "b"), (3, "c"))):
    t = ChangeTable(spark, str(tmp_path / "t"), ["k"], "pos", buckets=4)
    t.baseline(spark.createDataFrame(list(rows), "k long, v string"), 10)
    return t


def now(t):
    return dict(map(tuple, t.current().select("k", "v").collect()))


def batch(t, number, *rows):
    t.apply(t.spark.createDataFrame(list(rows), SCHEMA), number)


def test_operations_by_position_whatever_the_batches(spark, tmp_path):
    t = started(spark, tmp_path)
    assert (t.state(), now(t)) == ("baseline", {1: "a", 2: "b", 3: "c"})
    batch(t, 0, (1, 20, "U", "A"), (2, 21, "D", None), (4, 12, "I", "d"), (5, 9, "I", "before the baseline"), (3, 15, "U", "x"), (3, 16, "U", "C"))
    assert (t.state(), now(t)) == ("catching_up", {1: "A", 3: "C", 4: "d"})
    batch(t, 1, (2, 20, "U", "late"), (4, 30, "D", None), (4, 30, "U", "at once"), (1, 19, "D", None))
    assert now(t) == {1: "A", 3: "C"}  # tombstones hold against late changes
    t.merge()
    assert now(t) == {1: "A", 3: "C"}
    batch(t, 2, (2, 19, "I", "late again"), (2, 40, "I", "B"))
    assert now(t) == {1: "A", 2: "B", 3: "C"}


def test_a_repeated_batch_changes_nothing_and_costs_what_it_holds(spark, tmp_path):
    t = started(spark, tmp_path, [(k, "x") for k in range(100)])
    for _ in range(2):
        batch(t, 0, (1, 20, "U", "A"), (2, 21, "D", None))
    assert len(now(t)) == 99 and now(t)[1] == "A"
    written = sum(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(tmp_path / "t" / "deltas"))
    assert written <= 2
    before = {p for p, _, _ in os.walk(tmp_path / "t" / "base")}
    t.merge()
    after = {p for p, _, _ in os.walk(tmp_path / "t" / "base")} - before
    assert 1 <= sum("bucket=" in p for p in after) <= 2  # of four
    batch(t, 0, (1, 20, "U", "A"), (2, 21, "D", None))  # a batch number that the base holds already
    assert len(now(t)) == 99


def test_what_is_no_change_is_set_aside(spark, tmp_path):
    t = started(spark, tmp_path)
    batch(t, 0, (None, 20, "U", "A"), (2, None, "D", None), (3, 22, "X", "?"), (3, 23, None, "?"), (3, 24, "D", None))
    assert now(t) == {1: "a", 2: "b"}
    assert t.refused().count() == 4


def test_cutover_waits_for_the_end(spark, tmp_path):
    t = started(spark, tmp_path)
    with pytest.raises(ValueError, match="up to 10"):
        t.cut_over(20)
    batch(t, 0, (1, 20, "D", None))
    t.cut_over(20)
    assert (t.state(), now(t)) == ("cut_over", {2: "b", 3: "c"})
    with pytest.raises(ValueError, match="cut_over"):
        batch(t, 1, (2, 30, "D", None))
    with pytest.raises(ValueError):
        t.baseline(t.current(), 1)


def test_another_reader_finds_the_layout(spark, tmp_path):
    started(spark, tmp_path)
    again = ChangeTable(spark, str(tmp_path / "t"), ["k"], "pos", buckets=99)
    assert again.buckets == 4 and now(again) == {1: "a", 2: "b", 3: "c"}


def test_empty_baseline(spark, tmp_path):
    t = ChangeTable(spark, str(tmp_path / "t"), ["k"], "pos", buckets=4)
    t.baseline(spark.createDataFrame([], "k long, v string"), 0)
    assert now(t) == {}
    batch(t, 0, (1, 1, "I", "a"))
    t.merge()
    assert now(t) == {1: "a"}
