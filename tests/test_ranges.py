import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from copperleaf.sources import ranges, records

SEED = 11


def sequential(data, in_blocks):
    """A reader from the file's begin on: records, empty ones, bytes left."""
    out, empty, at = [], 0, 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 2], "big")
        if n > 4 and at + n > len(data):
            break
        if n > 4 and in_blocks:
            k, end = at + 4, at + n
            while k + 4 <= end:
                m = int.from_bytes(data[k : k + 2], "big")
                if m > 4:
                    out.append(data[k + 4 : min(k + m, end)])
                empty += m <= 4
                k += max(m, 4)
        elif n > 4:
            out.append(data[at + 4 : at + n])
        else:
            empty += 1
        at += max(n, 4)
    return out, empty, len(data) - at


def described(r):
    return (len(r) + 4).to_bytes(2, "big") + b"\0\0" + r


def a_file(rng, n, longest, in_blocks, tail):
    rows = [bytes(rng.choices(rng.choice([range(256), range(3), [0]]), k=rng.randrange(longest))) for _ in range(n)]
    if in_blocks:
        return b"".join(described(b"".join(map(described, rows[i : i + 3]))) for i in range(0, n, 3)) + tail
    return b"".join(map(described, rows)) + tail


@pytest.mark.parametrize("in_blocks", [False, True])
@pytest.mark.parametrize("size", [50, 1000, 70000])
def test_chains_over_ranges_give_what_a_sequential_reader_gives(tmp_path, spark, in_blocks, size):
    rng = random.Random(SEED)
    want = {}
    for k, (n, longest, tail) in enumerate([(0, 1, b""), (3, 9, b"\0"), (200, 40, b"\0\x64\0\0xx"), (90, 900, b""), (12, 20000, b"\0\0\0\0" * 7)] if size > 50 else [(20, 60, b"\0\x64\0\0xx"), (4, 300, b"ab")]):
        data = a_file(rng, n, longest, in_blocks, tail)
        (tmp_path / f"f {k}%.dat").write_bytes(data)
        want[f"f {k}%.dat"] = sequential(data, in_blocks)
    name = lambda file: file.rsplit("/", 1)[1]
    got = {}
    for r in ranges.variable(spark, str(tmp_path), in_blocks, size).collect():
        got.setdefault(name(r.file), []).append((r.line_num, bytes(r.raw)))
    assert {k: sorted(x) for k, x in got.items()} == {k: [(i + 1, r) for i, r in enumerate(rows)] for k, (rows, *_) in want.items() if rows}
    counts = {name(r.file): (r.n_records, r.n_skipped, r.tail_bytes) for r in ranges.scan_counts(spark, str(tmp_path), "VB" if in_blocks else "V", size=size).collect()}
    assert counts == {k: (len(rows), empty, left) for k, (rows, empty, left) in want.items() if (tmp_path / k).stat().st_size}


@pytest.mark.parametrize("size", [10, 300, 70000, 200000])
def test_exits_of_all_entries(size):
    rng = random.Random(SEED + 1)
    data = a_file(rng, 3000, 120, False, b"\0\0\0\0" * 50 + bytes(rng.choices(range(256), k=500)))
    for begin in (0, 4000, len(data) - 400):
        own = min(size, len(data) - begin)
        part = data[begin : begin + own + ranges.OVER]
        found = ranges.exits(part, own, len(data) - begin)
        for entry in rng.sample(range(ranges.OVER), 300) + list(range(200)):
            for at, _ in ranges.descriptors(part, entry, own, len(data) - begin) if entry < own else [(entry, 0)]:
                pass
            assert found[entry] == (at - own if at != ranges.END else ranges.END)


def test_fixed_files_with_tails_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 10)
    (tmp_path / "a").write_bytes(b"aaabbbcccdddeeeff")
    (tmp_path / "b").write_bytes(b"xx")
    got = [(r.file.rsplit("/", 1)[1], r.line_num, bytes(r.raw)) for r in records.read_records(spark, str(tmp_path), "F", 3, 1).collect()]
    assert sorted(got) == [("a", i + 2, x * 3) for i, x in enumerate([b"b", b"c", b"d", b"e"])]
    counts = {r.file.rsplit("/", 1)[1]: (r.n_records, r.n_skipped, r.tail_bytes) for r in ranges.scan_counts(spark, str(tmp_path), "F", 3, 1).collect()}
    assert counts == {"a": (4, 1, 2), "b": (0, 0, 2)}


def test_lines_of_split_files(spark, tmp_path):
    rng = random.Random(SEED + 2)
    rows = [bytes(x for x in rng.choices(range(256), k=rng.randrange(60)) if x not in (10, 13)) for _ in range(3000)]
    rows[0] = b"first"
    (tmp_path / "a").write_bytes(b"\r\n".join(rows) + b"\r\n")
    (tmp_path / "b").write_bytes(b"one\n\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = records.read_records(spark, str(tmp_path), "D")
        got = sorted((r.file.rsplit("/", 1)[1], r.line_num, bytes(r.raw)) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("a", i + 1, r) for i, r in enumerate(rows)] + [("b", 1, b"one"), ("b", 2, b""), ("b", 3, b"two")]


def test_small_ranges_share_tasks_and_many_chains_go_on_at_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    body = lambda: bytes(rng.integers(48, 122, int(rng.integers(1, 60)), dtype=np.uint8))
    data = b"".join((len(b) + 4).to_bytes(2, "big") + b"\0\0" + b for b in (body() for _ in range(6000)))
    (tmp_path / "a").write_bytes(data)
    own, _ = ranges.counted(spark, str(tmp_path), False, 1000)
    assert own.rdd.getNumPartitions() <= ranges.TASKS_OF_CORE * spark.sparkContext.defaultParallelism < len(data) // 1000
    assert own.agg(F.sum("n")).first()[0] == 6000
    monkeypatch.setattr(ranges, "FEW", 0)
    got = ranges.exits(data, size := 150_000, len(data))
    for p in rng.integers(0, ranges.OVER, 200).tolist():
        *_, (at, _) = ranges.descriptors(data, p, size, len(data))
        assert got[p] == (at - size if at != ranges.END else ranges.END)
