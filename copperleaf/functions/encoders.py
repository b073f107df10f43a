"""The codecs the other way: typed columns to bytes of a record. A value that doesn't fit gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import DEFAULT_CODE_PAGE, LATIN, MINUS, NUL_STAND_IN, PLUS, backwards, code_page


def unscaled(value: Column, scale: int) -> Column:
    """Digits of |value| * 10^scale."""
    return F.abs(value.cast(f"decimal(38,{scale})") * F.lit(10**scale).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")


def fitted(digits: Column, n: int) -> Column:
    return F.when(F.length(digits) <= n, F.lpad(digits, n, "0"))


def packed(value: Column, length: int, scale: int = 0, sign: Column | None = None) -> Column:
    sign = F.when(value < 0, "D").otherwise("C") if sign is None else sign
    return F.unhex(F.concat(fitted(unscaled(value, scale), 2 * length - 1), sign))


def packed_unsigned(value: Column, length: int, scale: int = 0) -> Column:
    return F.unhex(fitted(unscaled(value, scale), 2 * length))


def binary(value: Column, length: int, big_endian: bool = True, scale: int = 0) -> Column:
    v = (value.cast(f"decimal(38,{scale})") * F.lit(10**scale)).cast("long") if scale else value.cast("long")
    b = F.unhex(F.right(F.lpad(F.hex(v), 16, "0"), F.lit(2 * length)))
    return b if big_endian else backwards(b, length)


def text(value: Column, length: int, page: str = DEFAULT_CODE_PAGE) -> Column:
    """Padded with spaces, cut at the length; characters outside the page become its substitute."""
    table = code_page(page)
    pairs = [(t, s if s != "\0" else NUL_STAND_IN) for s, t in zip(LATIN, table, strict=True) if s != t and t != "\ufffd"]
    latin = F.translate(F.rpad(value, length, " "), "".join(t for t, _ in pairs), "".join(s for _, s in pairs))
    return F.encode(F.replace(latin, F.lit(NUL_STAND_IN), F.lit("\0")), "ISO-8859-1")


def ascii_text(value: Column, length: int) -> Column:
    return F.encode(F.rpad(value, length, " "), "UTF-8")


def zoned(value: Column, length: int, scale: int = 0, signed: bool = True, separate: str | None = None) -> Column:
    """Characters of a number, see codecs.zoned."""
    sign = F.when(value < 0, "-").otherwise("+")
    if separate:
        d = fitted(unscaled(value, scale), length - 1)
        return F.concat(sign, d) if separate == "leading" else F.concat(d, sign)
    d = fitted(unscaled(value, scale), length)
    if not signed:
        return d
    last = F.substring(d, -1, 1)
    return F.concat(F.left(d, F.lit(length - 1)), F.when(value < 0, F.translate(last, "0123456789", MINUS)).otherwise(F.translate(last, "0123456789", PLUS)))


def ieee(value: Column, length: int = 8) -> Column:
    """Finite normal numbers and zero, big-endian."""
    bias, bits = (127, 23) if length == 4 else (1023, 52)
    a = F.abs(value.cast("double"))
    guess = F.floor(F.log2(a)).cast("int")
    two = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    e = F.when(two(guess) > a, guess - 1).when(two(guess + 1) <= a, guess + 1).otherwise(guess)
    m = F.rint((a / two(e) - 1.0) * float(1 << bits)).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).otherwise((e + bias).cast("long") * F.lit(1 << bits) + m)
    b = F.lpad(F.hex(size), 2 * length, "0")
    top = F.conv(F.left(b, F.lit(1)), 16, 10).cast("int")
    return F.unhex(F.concat(F.hex(F.when(value < 0, top + 8).otherwise(top).cast("long")), F.substring(b, 2, 2 * length - 1)))
