import datetime as dt
import math
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.functions import encoders as enc


def values(spark, hexes, make):
    df = spark.createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(hexes)], "i int, f binary")
    d = make(F.col("f"))
    return [(r.v, r.e) for r in df.select("i", d.value.alias("v"), d.error.alias("e")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("h", "scale", "want"),
    [("12345C", 0, "12345"), ("00100F", 0, "100"), ("09999D", 0, "-9999"), ("09999D", 2, "-99.99"), ("0C", 0, "0"), ("01234C", 2, "12.34"), ("00123A", 0, "123"), ("00123B", 0, "-123"), ("00999999999C", 0, "999999999"), ("1A234C", 0, None), ("123456", 0, None), ("0C", 3, "0.000")],
)
def test_packed(spark, h, scale, want):
    [(v, e)] = values(spark, [h], lambda f: codecs.packed(f, len(h) // 2, scale, max(len(h), scale)))
    assert v == (Decimal(want) if want else None) and (e is None) == (want is not None)


def test_packed_round_trip(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("12345", "-9999", "0")], "v decimal(9,0)")
    out = df.select("v", codecs.packed(enc.packed(F.col("v"), 3), 3, 0, 9).value.alias("w"), enc.packed(F.col("v"), 1).alias("small"))
    for r in out.collect():
        assert r.v == r.w and (r.small is None) == (abs(r.v) > 9)


def test_binary(spark):
    assert values(spark, ["FFFE", "0102"], lambda f: codecs.binary(f, 2)) == [(-2, None), (258, None)]
    assert values(spark, ["FFFE"], lambda f: codecs.binary(f, 2, signed=False)) == [(65534, None)]
    assert values(spark, ["FEFF"], lambda f: codecs.binary(f, 2, big_endian=False)) == [(-2, None)]
    assert values(spark, ["8000000000000000"], lambda f: codecs.binary(f, 8)) == [(-(2**63), None)]
    assert values(spark, ["FFFFFF85"], lambda f: codecs.binary(f, 4, scale=2)) == [(Decimal("-1.23"), None)]
    assert values(spark, ["010203"], lambda f: codecs.binary(f, 3))[0][1] == "invalid binary length 3"


@pytest.mark.parametrize("length", [4, 8])
def test_floats(spark, length):
    kind = ">f" if length == 4 else ">d"
    numbers = [0.0, 1.5, -2.25, math.inf, -math.inf, math.nan, 3.4e38 if length == 4 else 1.7976931348623157e308, 1e-45 if length == 4 else 5e-324, 0.1]
    for x, (v, _) in zip(numbers, values(spark, [struct.pack(kind, x).hex() for x in numbers], lambda f: codecs.ieee(f, length)), strict=True):
        want = struct.unpack(kind, struct.pack(kind, x))[0]
        assert v == want or math.isnan(v) and math.isnan(want)
        little = values(spark, [struct.pack(kind.replace(">", "<"), x).hex()], lambda f: codecs.ieee(f, length, big_endian=False))[0][0]
        assert little == want or math.isnan(want)


@pytest.mark.parametrize("page", ["cp037", "cp273", "cp500", "cp875", "cp1140", "no-such-page"])
def test_code_pages(spark, page):
    all_bytes = bytes(range(256))
    got = spark.createDataFrame([(bytearray(all_bytes),)], "f binary").select(codecs.characters(F.col("f"), page)).first()[0]
    assert got == all_bytes.decode(page if page != "no-such-page" else "cp037", "replace")


def test_ascii_with_bad_bytes(spark):
    assert values(spark, ["41FF20"], lambda f: codecs.ascii_text(f)) == [("A�", None)]


@pytest.mark.parametrize(
    ("text", "scale", "signed", "separate", "want"),
    [("1234E", 2, True, None, "123.45"), ("1234N", 2, True, None, "-123.45"), ("0000{", 0, True, None, "0"), ("     ", 0, True, None, "0"), ("  12", 0, False, None, "12"), ("1 2", 0, False, None, "102"), ("12x", 0, False, None, None), ("-123", 1, True, "leading", "-12.3"), ("123-", 1, True, "trailing", "-12.3")],
)
def test_zoned(spark, text, scale, signed, separate, want):
    d = codecs.zoned(F.lit(text), len(text), scale, signed, separate=separate)
    r = spark.range(1).select(d.value.alias("v"), d.error.alias("e")).first()
    assert r.v == (Decimal(want) if want else None) and (r.e is None) == (want is not None)


@pytest.mark.parametrize(
    ("text", "fmt", "pivot", "want"),
    [
        ("20240315", "YYYYMMDD", 30, "2024-03-15"), ("280315", "YYMMDD", 30, "2028-03-15"), ("450315", "YYMMDD", 30, "1945-03-15"), ("2024075", "YYYYDDD", 30, "2024-03-15"), ("28075", "YYDDD", 30, "2028-03-15"),
        ("03152024", "MMDDYYYY", 30, "2024-03-15"), ("15032024", "ddmmyyyy", 30, "2024-03-15"), ("2024-03-15", "YYYY-MM-DD", 30, "2024-03-15"), ("03/15/2024", "MM/DD/YYYY", 30, "2024-03-15"), ("202403", "YYYYMM", 30, "2024-03-01"),
        ("", "YYYYMMDD", 30, None), ("        ", "YYYYMMDD", 30, None), ("00000000", "YYYYMMDD", 30, None), ("99999999", "YYYYMMDD", 30, None), ("490315", "YYMMDD", 50, "2049-03-15"), ("510315", "YYMMDD", 50, "1951-03-15"),
        ("157604", "LILIAN", 30, "2014-04-16"), ("161941", "LILIAN", 30, "2026-03-01"), ("00000", "YYDDD", 30, "1999-12-31"), ("20240230", "YYYYMMDD", 30, None), ("2024400", "YYYYDDD", 30, "2025-02-03"), ("x", "YYYYMMDD", 30, None), ("20240315", "NONE", 30, None),
    ],
)
def test_dates(spark, text, fmt, pivot, want):
    assert spark.range(1).select(codecs.date_of(F.lit(text), fmt, pivot)).first()[0] == (dt.date.fromisoformat(want) if want else None)


def test_date_format_guess():
    assert [codecs.date_format_of(p) for p in ("9(8)", "9(7)", "9(6)", "9(5)", "X(30)", "S9(8)")] == ["YYYYMMDD", "YYYYDDD", "YYMMDD", "YYDDD", None, None]


def test_sentinels(spark):
    df = spark.createDataFrame([("99",), (" 99 ",), ("98",), (None,)], "v string")
    assert [r[0] for r in df.select(F.coalesce(codecs.is_sentinel(F.col("v"), ["99"]), F.lit(False))).collect()] == [True, True, False, False]
    n = spark.createDataFrame([(Decimal("9999999.90"),)], "v decimal(9,2)")
    assert n.select(codecs.is_sentinel(F.col("v"), ["9999999.9"])).first()[0]
