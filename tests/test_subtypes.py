import random

import pytest

from copperleaf.operators import subtypes
from copperleaf.operators.decode import DecodeOptions
from copperleaf.plans import engine
from copperleaf.plans.schema import Options, compile_copybook, from_json, to_json
from copperleaf.plans.state import Store

ASCII = DecodeOptions(ascii=True)
BOOK = """
01 REC.
   05 REC-KEY PIC 9(5).
   05 REC-NOISE PIC X.
   05 REC-TYPE PIC X(2).
   05 REC-A.
      10 A-NAME PIC X(6).
      10 A-CODE PIC X(2).
   05 REC-B REDEFINES REC-A.
      10 B-SUM PIC S9(7) COMP-3.
      10 B-NO PIC 9(4).
   05 REC-C REDEFINES REC-A.
      10 C-DAY PIC 9(8).
"""
BODY = {"AA": lambda r: ("".join(r.choices("ABCDEFGH", k=6)) + "zz").encode(), "BB": lambda r: bytes([0, r.choice(range(10)), 0x12, 0x3C]) + b"%04d" % r.randrange(10000), "CC": lambda r: b"%08d" % r.randrange(10**8)}


def table(redefines="subtype", book=BOOK):
    return compile_copybook(book, Options(redefines=redefines), free=True).tables[0]


def raw(seed=1, n=300, kinds=("AA", "BB", "CC")):
    r, out = random.Random(seed), []
    for k in range(n):
        kind = r.choice(kinds)
        out.append(b"%05d" % k + r.choice(b"xyz").to_bytes() + kind.encode() + BODY[kind](r))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "raw binary")


@pytest.mark.parametrize("redefines", ["subtype", "wide"])
def test_the_field_is_found(spark, redefines):
    found = subtypes.discriminator(frame(spark, raw()), table(redefines), options=ASCII)
    assert found.column.source == "REC-TYPE" and found.layouts == {"AA": 0, "BB": 1, "CC": 2}


def test_a_share_of_broken_records_changes_nothing(spark):
    rows = [x[:8] + b"\x01\x02" + x[10:] if k % 9 == 0 else x for k, x in enumerate(raw())]
    assert subtypes.discriminator(frame(spark, rows), table(), options=ASCII).layouts == {"AA": 0, "BB": 1, "CC": 2}


@pytest.mark.parametrize("rows", [[], raw(kinds=("AA",)), [x[:8] for x in raw()], [None, b""]])
def test_nothing_to_tell(spark, rows):
    """No records, one layout only, records that end before the area, null and empty ones."""
    assert subtypes.discriminator(frame(spark, rows), table(), options=ASCII) is None


def test_values_beyond_the_limit_are_no_types(spark):
    rows = [x[:6] + b"%02d" % (k % 90) + x[8:] for k, x in enumerate(raw(n=900))]
    assert subtypes.discriminator(frame(spark, rows), table(), options=ASCII, most=64) is None


def test_a_tested_field_goes_first(spark):
    """Two fields that tell equally well: the one that a program tests, or the first."""
    rows = [x[:5] + x[6:7] + x[6:] for x in raw()]
    assert subtypes.discriminator(frame(spark, rows), table(), options=ASCII).column.source == "REC-NOISE"
    assert subtypes.discriminator(frame(spark, rows), table(), options=ASCII, named=["REC-TYPE"]).column.source == "REC-TYPE"


def test_areas_by_brute_force(spark):
    """Costs of each value, summed record by record."""
    t, rows = table(), raw(n=60)
    area = subtypes.areas(t)[0]
    assert (area.offset, area.length, [o.name for o in area.overlays]) == (8, 8, ["rec_b", "rec_c"])
    assert [[c.name for c in x] for x in subtypes.layouts(t, area)] == [["a_name", "a_code"], ["b_sum", "b_no"], ["c_day"]]
    fields = subtypes.candidates(t)
    assert [c.source for c in fields] == ["REC-KEY", "REC-NOISE", "REC-TYPE"]
    got = {(r.field, r.value): (r.n, r.cost_2) for r in subtypes.costs(frame(spark, rows), t, area, fields, ASCII).collect()}
    want: dict = {}
    for x in rows:
        cost = 26575 if x[8:16].isdigit() else 65000
        for k, v in enumerate((x[:5], x[5:6], x[6:8])):
            n, s = want.get((k, v.decode()), (0, 0))
            want[k, v.decode()] = n + 1, s + cost
    assert got == want


def test_overlays_survive_json():
    schema = compile_copybook(BOOK, Options(redefines="subtype"), free=True)
    assert from_json(to_json(schema)) == schema
    assert [c.name for c in schema.table("rec_rec_b").columns] == ["rec_key", "rec_noise", "rec_type", "b_sum", "b_no"]


PROGRAM = """
PROCEDURE DIVISION.
    EVALUATE rec-type WHEN 'AA' PERFORM P-A WHEN 'BB' PERFORM P-B END-EVALUATE.
"""


@pytest.mark.parametrize("program", [None, PROGRAM])
def test_a_run_loads_the_tables_of_overlays(spark, tmp_path, program):
    (tmp_path / "data").mkdir()
    rows = raw(n=100)
    (tmp_path / "data" / "a.dat").write_bytes(b"".join(rows))
    source = engine.Source(str(tmp_path / "data"), discriminate=True)
    c = engine.RunConfig("p", BOOK, [source], str(tmp_path / "out"), str(tmp_path / "state"), options=Options(redefines="subtype"), decoding=ASCII, free=True, program=program)
    run = engine.run(spark, c)
    assert Store(spark, c.state).status(run) == "completed"
    n = {t: spark.read.parquet(f"{c.target}/{t}").count() for t in ("rec", "rec_rec_b", "rec_rec_c")}
    assert n == {t: sum(x[6:8] == k for x in rows) for t, k in (("rec", b"AA"), ("rec_rec_b", b"BB"), ("rec_rec_c", b"CC"))}


def test_a_run_without_a_telling_field_says_so(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.dat").write_bytes(b"".join(raw(n=20, kinds=("AA",))))
    source = engine.Source(str(tmp_path / "data"), discriminate=True)
    c = engine.RunConfig("p", BOOK, [source], str(tmp_path / "out"), str(tmp_path / "state"), options=Options(redefines="subtype"), decoding=ASCII, free=True)
    with pytest.warns(UserWarning, match="no field tells"):
        engine.run(spark, c)
    assert spark.read.parquet(f"{c.target}/rec").count() == 20
