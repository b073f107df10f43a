import hashlib
import json

import pytest
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.operators import load
from copperleaf.plans import copybook, ddl, engine
from copperleaf.plans.catalog import PAGES, RUN_ORDER
from copperleaf.plans.schema import Options, compile_copybook, snake
from copperleaf.plans.state import Store, recent_runs
from copperleaf.sources import records


def config(tmp_path, rows, **more):
    folder = tmp_path / "data"
    folder.mkdir(exist_ok=True)
    (folder / "a.dat").write_bytes("".join(rows).encode())
    return engine.RunConfig("p", RUN_ORDER, [engine.Source(str(folder))], str(tmp_path / "out"), str(tmp_path / "state"), decoding=engine.DecodeOptions(ascii=True), free=True, **more)


def row(key, status, bad=False):
    return f"{key:09d}{status}" + "".join(f"{key + k:09d}{k:03d}" if not bad else "x" * 12 for k in (1, 2, 3)) + "file;"


def test_children_and_fields_named_like_bookkeeping(spark, tmp_path):
    c = config(tmp_path, [row(1, "O"), row(2, "Z"), row(3, "F"), row(3, "F")])
    run = engine.run(spark, c)
    main = spark.read.parquet(f"{c.target}/run_order")
    assert main.columns == ["ro_key", "ro_status", "ro_file"] and sorted(map(tuple, main.collect())) == [(1, "O", "file"), (3, "F", "file")]
    assert spark.read.parquet(f"{c.target}/run_order_ro_parts").count() == 6
    store = Store(spark, c.state)
    log = store.rows("rejection_log").collect()
    assert sorted((r.error_message, r.source_line_num) for r in log if r.error_message != "duplicate key") == sorted([("check chk_run_order_ro_status", 2), *[("run_order: check chk_run_order_ro_status", 2)] * 3, *[("run_order: duplicate key", 4)] * 3])
    assert sum(r.error_message == "duplicate key" for r in log) == 1
    assert store.status(run) == "completed"
    checks = {(r.check, r.table_name): r.passed for r in engine.validate(spark, c, run).collect()}
    assert checks["row_count", "run_order"] and checks["in_target", "run_order"] and not checks["rejection_rate", "run_order"]
    assert engine.preview(spark, c, 2).count() == 2


@pytest.mark.parametrize("mode", ["truncate_load", "append", "upsert"])
def test_children_land_with_their_parents(spark, tmp_path, mode):
    """Undecodable, refused, repeated and replaced parents: no child is left without its own record's row."""
    other = f"{4:09d}O" + "".join(f"{70 + k:09d}{k:03d}" for k in (1, 2, 3)) + "late;"
    c = config(tmp_path, [row(1, "O"), "xxxxxxxxxO" + row(2, "O")[10:], row(3, "Z"), row(4, "O"), other], mode=mode)
    run = engine.run(spark, c)
    main = {r.ro_key: r.ro_file for r in spark.read.parquet(f"{c.target}/run_order").collect()}
    parts = sorted((r.ro_key, r.rp_part) for r in spark.read.parquet(f"{c.target}/run_order_ro_parts").collect())
    last = mode == "upsert"
    assert main == {1: "file", 4: "late" if last else "file"}
    assert parts == [(1, 2), (1, 3), (1, 4), *((4, x) for x in ((71, 72, 73) if last else (5, 6, 7)))]
    log = Store(spark, c.state).rows("rejection_log").collect()
    why = {(r.source_line_num, r.error_message) for r in log if r.error_message.startswith("run_order: ")}
    assert {n for n, _ in why} == {2, 3, 4 if last else 5}
    assert Store(spark, c.state).status(run) == "completed"


def test_children_of_a_failed_table_fail(spark, tmp_path, monkeypatch):
    c = config(tmp_path, [row(1, "O")])
    real = load.load
    monkeypatch.setattr(load, "load", lambda rows, path, *a: real(rows, path, *a) if path.endswith("parts") else 1 / 0)
    run = engine.run(spark, c)
    states = {r.table_name: r.status for r in Store(spark, c.state).latest("table_migration_states").where(F.col("run_id") == run).collect()}
    assert states == {"run_order": "failed", "run_order_ro_parts": "failed"}


BOXES = """
01 SHIP.
   05 S-KEY PIC 9(2).
   05 S-BOXES PIC 9.
   05 BOX OCCURS 0 TO 2 TIMES DEPENDING ON S-BOXES.
      10 B-NO PIC 9.
      10 B-ITEMS PIC 9.
      10 ITEM OCCURS 0 TO 3 TIMES DEPENDING ON B-ITEMS.
         15 I-NO PIC 9.
         15 TAG PIC X OCCURS 2 TIMES.
"""


def test_arrays_inside_arrays(spark, tmp_path):
    """Three levels: counters of the record and of the element around, a bad element takes what lies in it along."""
    schema = compile_copybook(BOXES, free=True)
    assert [(t.name, t.parent, t.primary_key) for t in schema.tables] == [
        ("ship", None, ["s_key"]),
        ("ship_box", "ship", ["s_key", "occurrence_index"]),
        ("ship_box_item", "ship_box", ["s_key", "occurrence_index", "occurrence_index_2"]),
        ("ship_box_item_tag", "ship_box_item", ["s_key", "occurrence_index", "occurrence_index_2", "occurrence_index_3"]),
    ]
    assert [(r.child, r.parent) for r in schema.relationships] == [("ship_box", "ship"), ("ship_box_item", "ship_box"), ("ship_box_item_tag", "ship_box_item")]
    assert 'REFERENCES "public"."ship_box_item"' in ddl.script(schema)
    folder = tmp_path / "data"
    folder.mkdir()
    rows = ["012" + "12" + "1ab2cd000" + "21" + "3ef000000", "021" + "x1" + "1gh000000" + "90" + "000000000", "031" + "41" + "xij000000" + "00000000000"]
    (folder / "a.dat").write_text("".join(rows))
    c = engine.RunConfig("p", BOXES, [engine.Source(str(folder))], str(tmp_path / "out"), str(tmp_path / "state"), decoding=engine.DecodeOptions(ascii=True), free=True)
    engine.run(spark, c)
    of = lambda t: sorted(map(tuple, spark.read.parquet(f"{c.target}/{t}").collect()))
    assert of("ship") == [(1, 2), (2, 1), (3, 1)]
    assert of("ship_box") == [(1, 1, 1, 2), (1, 2, 2, 1), (3, 1, 4, 1)]
    assert of("ship_box_item") == [(1, 1, 1, 1), (1, 1, 2, 2), (1, 2, 1, 3)]
    assert of("ship_box_item_tag") == [(1, 1, 1, 1, "a"), (1, 1, 1, 2, "b"), (1, 1, 2, 1, "c"), (1, 1, 2, 2, "d"), (1, 2, 1, 1, "e"), (1, 2, 1, 2, "f")]
    why = sorted({(r.source_line_num, r.error_message) for r in Store(spark, c.state).rows("rejection_log").collect() if ": " in r.error_message and r.error_message.startswith("ship")})
    assert {n for n, _ in why} == {2, 3} and any(m.startswith("ship_box_item: ") for _, m in why)


def test_nested_arrays_as_json(spark, tmp_path):
    (tmp_path / "a.dat").write_text("012" + "12" + "1ab2cd000" + "21" + "3ef000000")
    c = engine.RunConfig("p", BOXES, [engine.Source(str(tmp_path / "a.dat"))], str(tmp_path / "out"), str(tmp_path / "state"), decoding=engine.DecodeOptions(ascii=True), free=True, options=Options(occurs="json"))
    engine.run(spark, c)
    [r] = spark.read.parquet(f"{c.target}/ship").collect()
    boxes = json.loads(r.box_array)
    assert [[i["i_no"] for i in b["item"]] for b in boxes] == [[1, 2], [3]] and [t["tag"] for t in boxes[0]["item"][1]["tag"]] == ["c", "d"]


def test_unknown_columns_are_named():
    with pytest.raises(ValueError, match="no column nowhere"):
        compile_copybook(RUN_ORDER, free=True).tables[0].column("nowhere")


def test_a_failed_table_fails_the_run(spark, tmp_path):
    c = config(tmp_path, [row(1, "O")], mode="upsert", options=Options(primary_key={"RUN-ORDER": []}))
    c.mode = "no such mode"
    run = engine.run(spark, c)
    r = Store(spark, c.state).latest("migration_runs").where(F.col("id") == run).first()
    assert r.status == "failed" and "run_order" in r.error_message


def test_cancelled_runs_take_no_further_table(spark, tmp_path, monkeypatch):
    c = config(tmp_path, [row(1, "O")])
    monkeypatch.setattr(Store, "status", lambda self, run: "cancelled")
    engine.run(spark, c)
    assert Store(spark, c.state).rows("table_migration_states").count() == 0


def test_deleting_a_project_deletes_what_it_owns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "state"))
    a, b = store.add_project("a", description="x"), store.add_project("b")
    store.update_project(a, name="c", description=None)
    assert [(r.name, r.description) for r in store.latest("projects").where(F.col("id") == a).collect()] == [("c", "x")]
    (tmp_path / "m.cpy").write_text("01 A PIC X.")
    store.add_copybook(a, str(tmp_path / "m.cpy"))
    (tmp_path / "d").write_bytes(b"x" * 40)
    store.add_sources(a, str(tmp_path / "d"), "F", 20)
    [f] = store.rows("source_files").collect()
    assert (f.filename, f.total_records, f.file_checksum) == ("d", 2, hashlib.sha256(b"x" * 40).hexdigest())
    for p in (a, a, b):
        run = store.start_run(p)
        state = store.start_table(run, "t")
        rows = spark.createDataFrame([(1, bytearray(b"x"), "why", 5)], "line_num long, raw binary, reject_reason string, k int")
        store.log_refusals(run, state, rows)
        store.tell(run, "run_complete")
    assert [r.run_number for r in recent_runs(store.latest("migration_runs"), a).collect()] == [2, 1]
    store.delete("projects", a)
    left = {t: store.rows(t).count() for t in ("projects", "copybooks", "source_files", "migration_runs", "table_migration_states", "rejection_log", "progress_events")}
    assert left == {"projects": 1, "copybooks": 0, "source_files": 0, "migration_runs": 1, "table_migration_states": 1, "rejection_log": 1, "progress_events": 1}
    store.cancel_run(run)
    assert store.status(run) == "cancelled"


def test_a_load_that_broke_off_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    load.load(rows, path)
    (tmp_path / "t").rename(tmp_path / "t__old")
    load.recover(spark, path)
    assert spark.read.parquet(path).count() == 1
    load.load(rows.withColumn("v", F.lit("b")), path, "upsert", ["k"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "b")]


def test_fixed_files_are_split(spark, tmp_path):
    data = b"".join(b"%07d" % i for i in range(5000))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a").write_bytes(data)
    (tmp_path / "f" / "b").write_bytes(data[:70])
    conf = spark._jsc.hadoopConfiguration()
    key = "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(key, "4001")
    try:
        rows = records.read_records(spark, str(tmp_path / "f"), "F", 7, skip=2)
        assert rows.rdd.getNumPartitions() > 8
        got = sorted((r.file[-1], r.line_num, bytes(r.raw)) for r in rows.collect())
    finally:
        conf.unset(key)
    assert got == [("a", i + 1, b"%07d" % i) for i in range(2, 5000)] + [("b", i + 1, b"%07d" % i) for i in range(2, 10)]
    (tmp_path / "f" / "c").write_bytes(data[:72])
    assert records.read_records(spark, str(tmp_path / "f"), "F", 7).count() == 5020


def test_checksums_follow_content_and_order(spark, tmp_path):
    for name, data in (("a", b"aabbcc"), ("b", b"aaccbb"), ("c", b"aabbcc")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.dat").write_bytes(data)
    of = lambda x, *more: records.source_checksum(spark, str(tmp_path / x), *more)
    for kind in (("F", 2), ("V",)):
        assert of("a", *kind) == of("c", *kind) != of("b", *kind)
    with pytest.raises(ValueError):
        engine.RunConfig("p", "", [], "t", "s", mode="replace")


def test_code_pages_of_the_jvm(spark):
    codecs.code_page.cache_clear()
    tables = {p: codecs.code_page(p) for p in PAGES}
    assert len(set(tables.values())) == len(PAGES)
    assert all(t[0xC1] == "A" and t[0xF0] == "0" for t in tables.values())
    assert tables["cp1047"][0xAD] == "[" and tables["cp277"][0x5B] == "\u00c5" and tables["cp1141"][0x9F] == "\u20ac"
    with pytest.warns(UserWarning):
        assert codecs.code_page("cp99999") == tables["cp037"]


def test_copy_and_replace_by_tokens(tmp_path):
    (tmp_path / "M.cpy").write_text("05 :TAG:-A PIC X(3).\n05 OLD PIC 9.\n")
    text = "01 R.\nCOPY M OF LIB REPLACING ==:TAG:== BY ==NEW== ==OLD== BY ==B==.\nREPLACE ==X1== BY ==Y1==.\n05 X1 PIC X.\nREPLACE OFF.\n05 X1 PIC X.\nCOPY NONE.\n"
    items = copybook.parse(text, [str(tmp_path)], free=True)
    assert [c.name for c in items[0].children] == ["NEW-A", "B", "Y1", "X1"]
    assert "COPY NONE NOT FOUND" in copybook.preprocess(text, [str(tmp_path)], free=True)


def test_program_sections():
    text = "DATA DIVISION.\nFILE SECTION.\nFD CUST RECORDING MODE F.\n01 CUST-REC.\n 05 A PIC X.\nWORKING-STORAGE SECTION.\n77 N PIC 9.\n01 W.\n 05 B PIC X.\nLINKAGE SECTION.\n01 L PIC X.\nPROCEDURE DIVISION.\nMAIN.\n"
    facts = copybook.program_facts(text, free=True)
    assert facts["sections"] == [("FILE", "CUST", ["CUST-REC"]), ("WORKING-STORAGE", "", ["N", "W"]), ("LINKAGE", "", ["L"])]
    assert facts["sha256"] == [hashlib.sha256(text.encode()).hexdigest()]


def test_lookup_tables_and_names():
    schema = compile_copybook(RUN_ORDER, free=True)
    text = ddl.script(schema, lookups=True)
    assert "INSERT INTO \"public\".\"run_order_ro_status_values\" (\"value\", \"name\") VALUES ('O', 'RO-KNOWN'), ('F', 'RO-KNOWN');" in text
    assert "values" not in ddl.script(schema)
    assert [snake(x) for x in ("CUST-NAME", "-A#B-", "---", "\u00c9T\u00c9")] == ["cust_name", "a_b", "field", "t"]
    with pytest.warns(UserWarning):
        compile_copybook(RUN_ORDER, Options(filler="warn"), free=True)


def test_command_line_routes():
    from copperleaf.__main__ import route_of

    assert route_of("0,1,O=order_rec,L=line_rec") == (0, 1, {"O": "order_rec", "L": "line_rec"}) and route_of(None) is None


def test_children_land_without_joins_and_only_repeated_keys_are_sorted(spark, tmp_path, monkeypatch):
    seen, real = [], load.without_repeats
    monkeypatch.setattr(engine, "with_parents", None)  # not called where a run loads parents and children
    monkeypatch.setattr(load, "without_repeats", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    c = config(tmp_path, [row(1, "O"), row(2, "Z"), row(3, "F"), row(3, "F"), *(row(k, "O") for k in range(4, 40))])
    run = engine.run(spark, c)
    assert Store(spark, c.state).status(run) == "completed" and seen == [2]
    assert spark.read.parquet(f"{c.target}/run_order").count() == 38 and spark.read.parquet(f"{c.target}/run_order_ro_parts").count() == 3 * 38
    why = Store(spark, c.state).rows("rejection_log").groupBy("source_line_num", "error_message").count().collect()
    assert sorted(map(tuple, why)) == [(2, "check chk_run_order_ro_status", 1), (2, "run_order: check chk_run_order_ro_status", 3), (4, "duplicate key", 1), (4, "run_order: duplicate key", 3)]
