"""Column expressions that turn bytes of a record into typed values. No Python runs on the executors.

Each codec returns Decoded: the value, null where the bytes are bad, and the message that says why, null where they
are good. A null message with a null value is a legal null.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decoded:
    value: Column
    error: Column

    def nulled(self, when: Column) -> Decoded:
        """The same with a legal null where the condition holds."""
        return Decoded(F.when(~F.coalesce(when, F.lit(False)), self.value), self.error)


def no_error() -> Column:
    return F.lit(None).cast("string")


def checked(value: Column, good: Column, message: str) -> Decoded:
    return Decoded(F.when(good, value), F.when(~good, F.lit(message)))


def slice_of(raw: Column, offset: int | Column, length: int | Column) -> Column:
    """Bytes offset..offset+length of a record; offsets count from 0."""
    return F.substring(raw, offset + 1 if isinstance(offset, Column) else F.lit(offset + 1), length if isinstance(length, Column) else F.lit(length))


def pointed(digits: Column, n: int, scale: int, precision: int | None = None) -> Column:
    """A string of n digits as decimal with the last `scale` of them after the point."""
    p = min(38, precision or max(n, scale, 1))
    if scale <= 0:
        return digits.try_cast(f"decimal({p},0)")
    padded = F.lpad(digits, max(n, scale + 1), "0")
    return F.concat(F.substring(padded, 1, max(n, scale + 1) - scale), F.lit("."), F.substring(padded, max(n, scale + 1) - scale + 1, scale)).try_cast(f"decimal({p},{scale})")


def backwards(f: Column, length: int) -> Column:
    """Bytes in reverse order; reverse() would read them as text."""
    h = F.hex(f)
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(length)))))


# --- packed decimal -----------------------------------------------------------------------------------------------


def packed(f: Column, length: int, scale: int = 0, precision: int | None = None) -> Decoded:
    return packed_hex(F.hex(f), length, scale, precision)


def packed_hex(h: Column, length: int, scale: int = 0, precision: int | None = None) -> Decoded:
    """Two digits a byte, the last half byte the sign: C F A E plus, D B minus. No bytes are zero."""
    if length == 0:
        return Decoded(F.lit(0).cast(f"decimal({precision or 1},{scale})"), no_error())
    n = 2 * length - 1
    v = pointed(F.substring(h, 1, n), n, scale, precision)
    return checked(F.when(F.substring(h, n + 1, 1).isin("D", "B"), -v).otherwise(v), h.rlike("^[0-9]+[A-F]$"), "invalid packed decimal")


def packed_unsigned(f: Column, length: int, scale: int = 0, precision: int | None = None) -> Decoded:
    return packed_unsigned_hex(F.hex(f), length, scale, precision)


def packed_unsigned_hex(h: Column, length: int, scale: int = 0, precision: int | None = None) -> Decoded:
    return checked(pointed(h, 2 * length, scale, precision), h.rlike("^[0-9]+$"), "invalid unsigned packed decimal")


# --- binary numbers -----------------------------------------------------------------------------------------------

BINARY_LENGTHS = (1, 2, 4, 8)


def whole(f: Column, length: int, signed: bool) -> Column:
    """Big-endian bytes as decimal(20,0)."""
    if signed and length == 8:
        return F.conv(F.hex(f), 16, -10).cast("decimal(20,0)")
    v = F.conv(F.hex(f), 16, 10).cast("decimal(20,0)")
    if not signed:
        return v
    return F.when(v >= F.lit(1 << (8 * length - 1)), v - F.lit(1 << (8 * length))).otherwise(v).cast("decimal(20,0)")


def binary(f: Column, length: int, signed: bool = True, big_endian: bool = True, scale: int = 0) -> Decoded:
    """Two's complement of 1, 2, 4 or 8 bytes; with a scale, a decimal."""
    if length not in BINARY_LENGTHS:
        return Decoded(F.lit(None).cast("decimal(20,0)"), F.lit(f"invalid binary length {length}"))
    v = whole(f if big_endian else backwards(f, length), length, signed)
    if scale:
        v = (v * F.lit(f"1E-{scale}").cast(f"decimal({scale + 1},{scale})")).cast(f"decimal({min(38, 20 + scale)},{scale})")
    return Decoded(v, no_error())


def unsigned_index(f: Column, length: int = 4, big_endian: bool = True) -> Decoded:
    return Decoded(F.conv(F.hex(f if big_endian else backwards(f, length)), 16, 10).cast("decimal(20,0)"), no_error())


def ieee(f: Column, length: int, big_endian: bool = True) -> Decoded:
    """IEEE 754 numbers of 4 or 8 bytes, from their bits: sign, exponent, fraction."""
    exponent_bits, fraction_bits = (8, 23) if length == 4 else (11, 52)
    bits = F.conv(F.hex(f if big_endian else backwards(f, length)), 16, -10).cast("long")
    top, bias = (1 << exponent_bits) - 1, (1 << (exponent_bits - 1)) - 1
    e = F.shiftrightunsigned(bits, fraction_bits).bitwiseAND(F.lit(top)).cast("int")
    m = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    two = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    size = (
        F.when(e == top, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(e == 0, m * two(F.lit(1 - bias)) * two(F.lit(-fraction_bits)))
        .otherwise((m * two(F.lit(-fraction_bits)) + 1.0) * two(e - bias))
    )
    negative = F.shiftrightunsigned(bits, 8 * length - 1).bitwiseAND(F.lit(1)) == 1
    v = F.when(negative, -size).otherwise(size)
    return Decoded(v.cast("float") if length == 4 else v, no_error())


# --- text ---------------------------------------------------------------------------------------------------------

DEFAULT_CODE_PAGE = "cp037"
#: Stands for NUL, which translate() would delete.
NUL_STAND_IN = "\ue000"
LATIN = "".join(map(chr, range(256)))


@lru_cache(maxsize=64)
def code_page(name: str) -> str:
    """The 256 characters of a single-byte code page: Python's, or else the JVM's. An unknown name means cp037, with a
    warning. Tables are made on the driver; executors see expressions only."""
    number = name.lower().replace("-", "").replace("ibm", "cp").removeprefix("cp")
    every = bytes(range(256))
    try:
        table = every.decode(f"cp{number}" if number.isdigit() else name, "replace")
    except LookupError:
        table = _of_jvm(number, every)
    if table is None or len(table) != 256:
        warnings.warn(f"unknown code page {name}, {DEFAULT_CODE_PAGE} is used", stacklevel=2)
        return code_page(DEFAULT_CODE_PAGE)
    return table


def _of_jvm(number: str, every: bytes) -> str | None:
    spark = SparkContext._active_spark_context
    if spark is None or not number.isdigit():
        return None
    # The names that Java gives to EBCDIC code pages.
    for name in (f"IBM{number.zfill(3)}", f"IBM0{number}", f"Cp{number}", f"x-IBM{number}"):
        if spark._jvm.java.nio.charset.Charset.isSupported(name):
            return spark._jvm.java.lang.String(bytearray(every), name)
    return None


def characters(f: Column, page: str = DEFAULT_CODE_PAGE) -> Column:
    """Bytes as characters of a code page."""
    table = code_page(page)
    source, target = zip(*((s, t if t != "\0" else NUL_STAND_IN) for s, t in zip(LATIN, table, strict=True) if s != t or t == "\0"), strict=True)
    return F.replace(F.translate(F.decode(f, "ISO-8859-1"), "".join(source), "".join(target)), F.lit(NUL_STAND_IN), F.lit("\0"))


def ebcdic_text(f: Column, page: str = DEFAULT_CODE_PAGE, strip: bool = True) -> Decoded:
    """Text without trailing spaces; other white space and NULs stay."""
    v = characters(f, page)
    return Decoded(F.rtrim(v) if strip else v, no_error())


def ascii_text(f: Column, strip: bool = True) -> Decoded:
    v = F.make_valid_utf8(f.cast("string"))
    return Decoded(F.rtrim(v) if strip else v, no_error())


WHITE = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


PLUS, MINUS = "{ABCDEFGHI", "}JKLMNOPQR"


def zoned_parts(text: Column, length: int, signed: bool = False, overpunch: bool = True, separate: str | None = None) -> tuple[Column, Column]:
    """Whether a number in characters is negative, and its digits, blanks before them gone and those inside as 0."""
    t, minus = F.rtrim(text), F.lit(False)
    if separate:
        minus = (F.substring(text, 1, 1) if separate == "leading" else F.substring(text, length, 1)) == "-"
        t = F.rtrim(F.substring(text, 2, length - 1) if separate == "leading" else F.substring(text, 1, length - 1))
    elif signed and overpunch:
        last = F.substring(t, -1, 1)
        minus = F.instr(F.lit(MINUS), last) > 0
        t = F.concat(F.left(t, F.greatest(F.length(t) - 1, F.lit(0))), F.translate(last, PLUS + MINUS, "01234567890123456789"))
    elif signed:
        minus, t = t.startswith("-"), F.regexp_replace(t, "^[+-]", "")
    return F.coalesce(minus, F.lit(False)), F.translate(F.ltrim(t), " ", "0")


def zoned_value(minus: Column, digits: Column, length: int, scale: int = 0) -> Decoded:
    n = max(length, 1)
    v = pointed(F.when(digits == "", "0").otherwise(digits), n, scale, min(38, n + (1 if scale >= n else 0)))
    return checked(F.when(minus, -v).otherwise(v), (digits == "") | digits.rlike("^[0-9]+$"), "invalid zoned number")


def zoned(text: Column, length: int, scale: int = 0, signed: bool = False, overpunch: bool = True, separate: str | None = None) -> Decoded:
    """A number in characters, the sign punched over the last digit or, separate ("leading", "trailing"), beside it.

    Blank or all zero is 0; anything but digits is an error."""
    return zoned_value(*zoned_parts(text, length, signed, overpunch, separate), length, scale)


# --- dates --------------------------------------------------------------------------------------------------------

NULL_DATES = ("00000000", "99999999", "0000000", "9999999", "000000", "999999", "00/00/0000", "99/99/9999")
#: Places of year, month and day, counted from 0, and their lengths; no entry: 1.
DATE_PARTS = {
    "YYYYMMDD": ((0, 4), (4, 2), (6, 2)),
    "YYMMDD": ((0, 2), (2, 2), (4, 2)),
    "MMDDYYYY": ((4, 4), (0, 2), (2, 2)),
    "DDMMYYYY": ((4, 4), (2, 2), (0, 2)),
    "MMDDYY": ((4, 2), (0, 2), (2, 2)),
    "DDMMYY": ((4, 2), (2, 2), (0, 2)),
    "YYYY-MM-DD": ((0, 4), (5, 2), (8, 2)),
    "ISO": ((0, 4), (5, 2), (8, 2)),
    "MM/DD/YYYY": ((6, 4), (0, 2), (3, 2)),
    "DD/MM/YYYY": ((6, 4), (3, 2), (0, 2)),
    "YYYYMM": ((0, 4), (4, 2), None),
}
JULIAN = {"YYYYDDD": 4, "YYDDD": 2}
FORMATS = (*DATE_PARTS, *JULIAN, "LILIAN")


def windowed(yy: Column, pivot: int) -> Column:
    """A two-digit year: up to the pivot in this century, above it in the last."""
    return F.when(yy <= pivot, yy + 2000).otherwise(yy + 1900)


def made_date(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def date_of(text: Column, fmt: str, pivot: int = 30) -> Column:
    """A date, or null for blanks, sentinels, what can't be read and unknown formats. Day numbers aren't range-checked."""
    fmt, t = fmt.upper(), stripped(text)
    number = lambda at, n: F.substring(t, at + 1, n).try_cast("int")
    if fmt in DATE_PARTS:
        year, month, day = DATE_PARTS[fmt]
        y = number(*year)
        d = made_date(y if year[1] == 4 else windowed(y, pivot), number(*month), number(*day) if day else F.lit(1))
    elif fmt in JULIAN:
        n = JULIAN[fmt]
        y = number(0, n)
        d = F.date_add(made_date(y if n == 4 else windowed(y, pivot), F.lit(1), F.lit(1)), number(n, 3) - 1)
    elif fmt == "LILIAN":
        d = F.date_add(F.lit("1582-10-15").cast("date"), t.try_cast("int") - 1)
    else:
        return F.lit(None).cast("date")
    return F.when(~((t == "") | t.isin(*NULL_DATES)), d)


def date_format_of(picture: str) -> str | None:
    """A guess from a picture of 9s alone."""
    digits = len(expand(picture)) if set(expand(picture)) == {"9"} else 0
    return {8: "YYYYMMDD", 7: "YYYYDDD", 6: "YYMMDD", 5: "YYDDD"}.get(digits)


def expand(picture: str) -> str:
    """A picture with its counts written out, in upper case: a number in brackets repeats the character before it."""
    out, rest = "", picture.upper()
    while rest:
        head, bracket, rest = rest.partition("(")
        out += head
        if bracket:
            count, closed, after = rest.partition(")")
            if out and closed and count.isdigit():
                out, rest = out[:-1] + out[-1] * int(count), after
            else:
                out += bracket
    return out


# --- sentinels ----------------------------------------------------------------------------------------------------


def is_sentinel(value: Column, sentinels: list[str]) -> Column:
    """Whether a value, as text or, where both are numbers, by value, is one of the list."""
    t = value.cast("string")
    hit = t.isin(*sentinels) | stripped(t).isin(*sentinels)
    numbers = [s for s in sentinels if s.strip().lstrip("+-").replace(".", "", 1).isdigit()]
    if numbers:
        hit = hit | F.coalesce(t.try_cast("decimal(38,10)").isin(*(F.lit(s).cast("decimal(38,10)") for s in numbers)), F.lit(False))
    return hit
