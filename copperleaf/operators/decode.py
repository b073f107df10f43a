"""Decoding records: every column of a table becomes one expression over raw, so unused ones are pruned."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.functions.codecs import Decoded
from copperleaf.plans import schema as ir

ERROR = "struct<column:string,byte_offset:int,byte_length:int,raw_hex:string,message:string>"


@dataclass(frozen=True)
class DecodeOptions:
    page: str = codecs.DEFAULT_CODE_PAGE
    ascii: bool = False
    big_endian: bool = True
    pivot: int = 30
    sentinels: tuple[str, ...] = ()


def text_of(f: Column, options: DecodeOptions, strip: bool = True) -> Column:
    return (codecs.ascii_text(f, strip) if options.ascii else codecs.ebcdic_text(f, options.page, strip)).value


def once(df: DataFrame) -> DataFrame:
    """df, its columns worked out once: filters above are not rewritten into the expressions below, which would repeat
    them many times over."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


IN_HEX = ("packed", "packed_unsigned")


def base(c: ir.Column, f: Column, options: DecodeOptions) -> Column:
    """What a column's codec reads: text, hex or the bytes themselves."""
    if c.kind in ("text", "zoned"):
        return text_of(f, options, strip=c.kind == "text" or bool(c.date_format))
    return F.hex(f) if c.kind in IN_HEX else f


def separate_sign(c: ir.Column) -> str | None:
    return None if c.sign == "overpunch" else c.sign


def codec(c: ir.Column, b: Column, options: DecodeOptions, parts: tuple[Column, Column] | None = None) -> Decoded:
    """By the column's kind, from its base; blank text is null in a nullable column."""
    match c.kind:
        case "packed":
            out = codecs.packed_hex(b, c.length, c.scale, c.precision)
        case "packed_unsigned":
            out = codecs.packed_unsigned_hex(b, c.length, c.scale, c.precision)
        case "binary":
            out = codecs.binary(b, c.length, c.signed, options.big_endian, c.scale)
        case "binary_little":
            out = codecs.binary(b, c.length, c.signed, False, c.scale)
        case "float":
            out = codecs.ieee(b, c.length, options.big_endian)
        case "index":
            out = codecs.unsigned_index(b, c.length, options.big_endian)
        case "zoned" if not c.date_format:
            out = codecs.zoned_value(*(parts or codecs.zoned_parts(b, c.length, c.signed, separate=separate_sign(c))), c.length, c.scale)
        case _:
            out = Decoded(codecs.date_of(b, c.date_format, options.pivot) if c.date_format else b, codecs.no_error())
    if c.nullable and c.kind in ("text", "zoned"):
        out = out.nulled(codecs.stripped(b) == "")
    if listed := [*c.sentinels, *([] if c.sentinels else options.sentinels)]:
        out = out.nulled(codecs.is_sentinel(out.value, listed))
    return out


def target(c: ir.Column) -> str:
    return "date" if c.date_format else c.type.spark


def finished(c: ir.Column, out: Decoded, raw: Column, at: int) -> tuple[Column, Column]:
    """Value and error (null if fine); a record that ends before the column is an error."""
    short = F.length(raw) < at + c.length
    message = F.when(short, F.lit("record too short")).otherwise(out.error)
    facts = F.struct(F.lit(c.name).alias("column"), F.lit(at).alias("byte_offset"), F.lit(c.length).alias("byte_length"), F.lower(F.hex(codecs.slice_of(raw, at, c.length))).alias("raw_hex"), message.alias("message"))
    return F.when(~short, out.value.try_cast(target(c))), F.when(message.isNotNull(), facts)


def decoded(c: ir.Column, raw: Column, options: DecodeOptions, offset: int | None = None) -> tuple[Column, Column]:
    """One column in one expression."""
    at = c.offset if offset is None else offset
    return finished(c, codec(c, base(c, codecs.slice_of(raw, at, c.length), options), options), raw, at)


def decode(records: DataFrame, columns: list[ir.Column] | ir.Table, options: DecodeOptions = DecodeOptions(), on_error: str = "reject") -> DataFrame:
    """The records' other columns, the decoded ones and errors. on_error "reject": a bad record has no values; "null": only bad columns have none.

    Columns are decoded in steps (text or hex, digits, value and error, verdict), each read from the one before, so an
    expression doesn't grow with the number of times it is used. Columns that nothing reads are pruned; "reject" needs the
    verdict on all of them, which takes no values."""
    columns = [c for c in (columns.columns if isinstance(columns, ir.Table) else columns) if c.kind not in ("row_number", "array", "overlay")]
    if on_error == "reject":
        return _strictly(records, columns, options)
    names, each = {c.name for c in columns}, list(enumerate(columns))
    others = [x for x in records.columns if x != "raw" and x not in names]
    raw = F.col("raw")
    step = records.select(*others, "raw", *(base(c, codecs.slice_of(raw, c.offset, c.length), options).alias(f"__b{i}") for i, c in each))
    of_parts = {i: codecs.zoned_parts(F.col(f"__b{i}"), c.length, c.signed, separate=separate_sign(c)) for i, c in each if c.kind == "zoned" and not c.date_format}
    step = step.select(*others, "raw", *(f"__b{i}" for i, _ in each), *(x.alias(f"__{k}{i}") for i, p in of_parts.items() for k, x in zip("md", p, strict=True)))
    pairs = [finished(c, codec(c, F.col(f"__b{i}"), options, (F.col(f"__m{i}"), F.col(f"__d{i}")) if i in of_parts else None), raw, c.offset) for i, c in each]
    step = step.select(*others, *(v.alias(f"__v{i}") for i, (v, _) in enumerate(pairs)), *(e.alias(f"__e{i}") for i, (_, e) in enumerate(pairs)))
    errors = F.array_compact(F.array(*(F.col(f"__e{i}") for i, _ in each)))
    return step.select(*others, *(F.col(f"__v{i}").alias(c.name) for i, c in each), errors.alias("errors"))


def _places(columns: list[ir.Column]) -> list[str]:
    """Regular expressions over a record in hex that match where all packed columns are well formed; columns that overlap
    are in different ones."""
    out: list[tuple[int, str]] = []
    for c in sorted((c for c in columns if c.kind in IN_HEX and c.length), key=lambda c: c.offset):
        digits = f"[0-9]{{{2 * c.length - 1}}}[A-F]" if c.kind == "packed" else f"[0-9]{{{2 * c.length}}}"
        k = next((k for k, (end, _) in enumerate(out) if end <= c.offset), None)
        end, text = (0, "^") if k is None else out[k]
        gap = 2 * (c.offset - end)
        item = (c.offset + c.length, f"{text}{f'.{{{gap}}}' if gap else ''}{digits}")
        out[len(out) if k is None else k : len(out) if k is None else k + 1] = [item]
    return [text for _, text in out]


def _strictly(records: DataFrame, columns: list[ir.Column], options: DecodeOptions) -> DataFrame:
    """decode() with on_error "reject". Whether a record is good is found first, by one pattern for all packed columns and
    the digits of zoned ones; bad records alone get the list of errors; values are made of what is asked for."""
    names = {c.name for c in columns}
    others = [x for x in records.columns if x != "raw" and x not in names]
    raw, empty = F.col("raw"), F.array().cast(f"array<{ERROR}>")
    sliced = lambda c: base(c, codecs.slice_of(raw, c.offset, c.length), options)
    zoned = [c for c in columns if c.kind == "zoned" and not c.date_format]
    parts = records.select(*others, "raw", *(codecs.zoned_parts(sliced(c), c.length, c.signed, separate=separate_sign(c))[1].alias(f"__d{i}") for i, c in enumerate(zoned)))
    good = F.length(raw) >= max([c.offset + c.length for c in columns], default=0)
    for pattern in _places(columns):
        good = good & F.hex(raw).rlike(pattern)
    for i, c in enumerate(zoned):
        good = good & F.coalesce((F.col(f"__d{i}") == "") | F.col(f"__d{i}").rlike("^[0-9]+$"), F.lit(False))
    if any(c.kind in ("binary", "binary_little") and c.length not in codecs.BINARY_LENGTHS for c in columns):
        good = F.lit(False)
    errors = F.array_compact(F.array(*(decoded(c, raw, options)[1] for c in columns)))
    step = once(parts.select(*others, "raw", F.when(good, empty).otherwise(errors).cast(f"array<{ERROR}>").alias("errors")))
    fine = F.size("errors") == 0
    step = step.select(*others, "raw", "errors", *(sliced(c).alias(f"__b{i}") for i, c in enumerate(columns)))
    return step.select(*others, *(F.when(fine, decoded_from(c, F.col(f"__b{i}"), raw, options)).alias(c.name) for i, c in enumerate(columns)), "errors")


def decoded_from(c: ir.Column, b: Column, raw: Column, options: DecodeOptions) -> Column:
    return finished(c, codec(c, b, options), raw, c.offset)[0]


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0).drop("errors")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") > 0)


def page_scores(records: DataFrame, pages: tuple[str, ...] = ("cp037", "cp273", "cp500", "cp1140", "latin-1")) -> DataFrame:
    """For each code page, the share of bytes that are printable ASCII, letters or digits through it: the best guess has the most."""
    share = lambda p: F.sum(F.length(F.regexp_replace(codecs.characters(F.col("raw"), p), "[^A-Za-z0-9 .,]", ""))) / F.sum(F.length("raw"))
    one = records.agg(*(share(p).alias(p) for p in pages))
    return one.select(F.explode(F.create_map(*(x for p in pages for x in (F.lit(p), F.col(p))))).alias("page", "score"))


def byte_histogram(records: DataFrame, *by: str) -> DataFrame:
    """by, counts: for each group (all records without one), how often each of the 256 bytes occurs in raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = list(zip(*(b.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * b.num_rows
            held: dict[tuple, np.ndarray] = {}
            for group, raw in zip(groups, b.column(len(by)).to_pylist(), strict=True):
                held[group] = held.get(group, 0) + np.bincount(np.frombuffer(raw or b"", np.uint8), minlength=256)
            keys = [pa.array([g[k] for g in held], b.schema.field(k).type) for k in range(len(by))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], [*by, "counts"])

    kinds = dict(records.dtypes)
    parts = records.select(*by, "raw").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "counts array<bigint>"]))
    return parts.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.get("counts", F.lit(i))), F.lit(0)) for i in range(256))).alias("counts"))


def likelihood(expected: dict[str, int] | None) -> Callable[[str], float]:
    """How likely a character is, as a logarithm: by a histogram of expected ones, or else by its kind."""
    if expected:
        total = sum(expected.values()) + 1
        return lambda c: math.log((expected.get(c, 0) + 1e-3) / total)

    def by_kind(c: str) -> float:
        if c == "\ufffd" or ord(c) < 32 and c not in "\t\n\r" or 127 <= ord(c) < 160:
            return -12.0
        if c in " etaoinsrhldcu":
            return -2.5
        if c.isascii():
            return -4.0 if c.isalnum() or c in ".,-" else -6.0
        return -6.5 if c.isalpha() else -7.0 if c == "€" else -8.0

    return by_kind


def page_ranking(counts: list[int], pages: Iterable[str], expected: dict[str, int] | None = None) -> list[tuple[str, float]]:
    """Code pages by the mean log-likelihood of the characters that a byte histogram means in them, the best first; pages
    that agree on all bytes that occur have equal scores. expected: how often characters occur in text of that kind."""
    chance, total = likelihood(expected), max(1, sum(counts))
    score = {p: sum(n * chance(c) for n, c in zip(counts, codecs.code_page(p), strict=True) if n) / total for p in pages}
    return sorted(((p, round(s, 9)) for p, s in score.items()), key=lambda x: (-x[1], x[0]))


def guessed_page(records: DataFrame, pages: Iterable[str], expected: dict[str, int] | None = None) -> list[str]:
    """The code pages that the records' bytes fit best: several where they can't be told apart. One pass, 256 counts."""
    ranking = page_ranking(byte_histogram(records).first()["counts"], pages, expected)
    return [p for p, s in ranking if s == ranking[0][1]]
