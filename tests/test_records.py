import pytest
from pyspark.sql import functions as F

from copperleaf.operators import load, reshape
from copperleaf.operators.decode import accepted, decode, rejected
from copperleaf.plans import engine
from copperleaf.plans.catalog import CUSTOMER, ORDER_LINES, customer_records, layout, table
from copperleaf.plans.state import Store, run_summary
from copperleaf.sources import records
from copperleaf.streaming import incremental


def v(*rows):
    return b"".join((len(r) + 4).to_bytes(2, "big") + b"\0\0" + r for r in rows)


def block(data):
    return (len(data) + 4).to_bytes(2, "big") + b"\0\0" + data


def read(spark, tmp_path, data, recfm, **options):
    (tmp_path / "x.dat").write_bytes(data)
    return [(r.line_num, bytes(r.raw)) for r in records.read_records(spark, str(tmp_path / "x.dat"), recfm, **options).orderBy("line_num").collect()]


def test_fixed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "AT_ONCE", 2)
    assert read(spark, tmp_path, b"aaabbbccc" + b"xx", "F", record_length=3) == [(1, b"aaa"), (2, b"bbb"), (3, b"ccc")]
    assert read(spark, tmp_path, b"aaabbbccc", "F", record_length=3, skip=2) == [(3, b"ccc")]
    assert read(spark, tmp_path, b"", "F", record_length=3) == []
    for recfm in ("F", "U"):
        with pytest.raises(ValueError):
            records.read_records(spark, "x", recfm)


def test_variable(spark, tmp_path):
    assert read(spark, tmp_path, v(b"") + v(b"one", b"three"), "V") == [(1, b"one"), (2, b"three")]
    assert read(spark, tmp_path, v(b"one") + b"\0\x64\0\0" + b"x" * 40, "V") == [(1, b"one")]


def test_blocked(spark, tmp_path):
    two = block(v(b"a", b"b", b"c")) + block(v(b"d", b"e"))
    assert read(spark, tmp_path, two, "VB") == [(i + 1, x.encode()) for i, x in enumerate("abcde")]
    cut = block(v(b"a") + b"\0\x20\0\0" + b"part")
    assert read(spark, tmp_path, cut, "VB") == [(1, b"a"), (2, b"part")]
    assert read(spark, tmp_path, block(v(b"a")) + b"\0\x40\0\0zz", "VB") == [(1, b"a")]


def test_lines(spark, tmp_path):
    assert read(spark, tmp_path, b"one\r\n\ntwo \xff\n", "D") == [(1, b"one"), (2, b""), (3, b"two \xff")]


def test_decode_keeps_nuls_and_prunes(spark):
    t = layout("01 R.\n 05 A PIC X(3).\n 05 B PIC S9(3) COMP-3.\n")
    rows = spark.createDataFrame([(bytearray(b"\xc1\x00\x40\x12\x3c"),), (bytearray(b"\xc1"),)], "raw binary")
    out = decode(rows, t, on_error="null")
    assert [r.a for r in out.collect()] == ["A\0", None]
    assert accepted(decode(rows, t)).count() == 1
    [bad] = rejected(decode(rows, t)).collect()
    assert bad.a is None and [e.column for e in bad.errors] == ["a", "b"]
    plan = out.select("a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "decimal" not in plan


def test_load_modes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 3), (None, "a", 4), (3, None, 5)], "k long, v string, n int")
    check = load.Check("v", "v", ("a", "b"))
    path, rejects = str(tmp_path / "t"), str(tmp_path / "r")
    assert load.load(rows, path, "append", ["k"], (check,), ["n"], rejects) == {"loaded": 2, "rejected": 3}
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect() if r.v) == [(1, "a")]
    assert sorted(r.reject_reason for r in spark.read.parquet(rejects).collect()) == ["check v", "duplicate key", "null in k"]
    load.load(spark.createDataFrame([(1, "b", 1), (9, "a", 1), (9, "b", 2)], "k long, v string, n int"), path, "upsert", ["k"], order=["n"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "b"), (3, None), (9, "b")]
    for bad in ({"mode": "upsert"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            load.load(rows, path, **bad)


def test_run(spark, sf, tmp_path):
    c = table(spark, sf, "customer")
    raws = [bytes(r.raw) for r in customer_records(c).orderBy("c_custkey").collect()]
    raws[3] = raws[3][:24] + b"\xff" * 6 + raws[3][30:]
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "c.dat").write_bytes(b"".join(raws))
    book = "".join(f"000000 {x}\n" for x in CUSTOMER.strip().splitlines())
    config = engine.RunConfig("p", book, [engine.Source(str(tmp_path / "data"))], str(tmp_path / "out"), str(tmp_path / "state"))
    first = engine.run(spark, config)
    assert spark.read.parquet(str(tmp_path / "out" / "customer_rec")).count() == len(raws) - 1
    store = Store(spark, config.state)
    r = store.latest("migration_runs").where(F.col("id") == first).first()
    assert (r.status, r.run_number, r.rows_extracted, r.rows_loaded, r.rows_rejected) == ("completed", 1, len(raws), len(raws) - 1, 1)
    [x] = store.rows("rejection_log").collect()
    assert x.source_line_num == 4 and x.error_message == "invalid packed decimal"
    second = engine.run(spark, config)
    assert store.latest("migration_runs").where(F.col("id") == second).first().run_number == 2
    assert run_summary(store.latest("table_migration_states")).count() == 1


def test_incremental_files(spark, tmp_path):
    seen: list[int] = []
    folder = tmp_path / "in"
    folder.mkdir()

    def go():
        incremental.new_files(spark, str(folder), str(tmp_path / "cp"), lambda rows: seen.append(rows.count()), str(tmp_path / "seen"))

    (folder / "a").write_bytes(b"one")
    go()
    (folder / "b").write_bytes(b"two")
    (folder / "a2").write_bytes(b"one")
    go()
    go()
    assert seen == [1, 1]


def test_an_array_read_without_its_counter_has_all_places(spark):
    t = layout(ORDER_LINES)
    body = b"".join(k.to_bytes(2, "big") + b"\x00\x00\x1c" + bytes(6) + b"\x0c" for k in (7, 8))
    rows = spark.createDataFrame([(bytearray((1).to_bytes(8, "big") + b"\x00\x01" + body.ljust(240, b"\0")),)], "raw binary")
    of = lambda *counter: [(r.occurrence_index, r.ol_num) for r in accepted(reshape.child_rows(rows, t.arrays[0], [t.column("oo_key")], *counter)).collect()]
    assert of() == [(1, 7), (2, 8)] and of(t.column("oo_count")) == [(1, 7)]
    assert reshape.child_rows(rows, t.arrays[0], [t.column("oo_key")]).count() == 20
