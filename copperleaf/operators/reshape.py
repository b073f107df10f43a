"""Routing by record type; arrays (OCCURS) and overlays (REDEFINES) as rows, arrays, wide columns or JSON."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.operators.decode import DecodeOptions, decode, decoded, text_of
from copperleaf.plans import schema as ir


def routed(records: DataFrame, offset: int, length: int, types: dict[str, str], default: str | None, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """records with table_name, by the characters at an offset; others go to the default table, or nowhere without one."""
    t = codecs.stripped(text_of(codecs.slice_of(F.col("raw"), offset, length), options))
    name = F.lit(default).cast("string")
    for value, table in types.items():
        name = F.when(t == value, F.lit(table)).otherwise(name)
    out = records.withColumn("table_name", name)
    return out if default else out.where("table_name is not null")


def of_table(records: DataFrame, name: str) -> DataFrame:
    return records.where(F.col("table_name") == name)


def element_count(a: ir.Array, counter: Column | None) -> Column:
    if counter is None:
        return F.lit(a.most)
    return F.greatest(F.lit(a.least), F.least(F.lit(a.most), counter.cast("int")))


def elements(a: ir.Array, raw: Column, counter: Column | None = None) -> Column:
    """array<binary> of the slices that are there; a counter is clamped to the bounds."""
    n = F.coalesce(element_count(a, counter), F.lit(0))
    all_of = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(raw, k * a.stride + (a.offset + 1), F.lit(a.stride)))
    return F.when(n > 0, all_of).otherwise(F.array().cast("array<binary>"))


def full_layout(records: DataFrame, t: ir.Table, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """records whose variable arrays (OCCURS DEPENDING ON) have all their places: elements that aren't there are zero bytes,
    so what follows is where the layout says. Records of the full length are left as they are."""
    out = records
    for a in sorted((a for a in t.arrays if a.counter), key=lambda a: a.offset):
        raw = F.col("raw")
        n = F.coalesce(element_count(a, decoded(t.column(a.counter), raw, options)[0]), F.lit(0))
        end = F.lit(a.offset) + n * a.stride
        gap = F.unhex(F.repeat(F.lit("00"), (F.lit(a.most) - n) * a.stride))
        wide = F.concat(F.substring(raw, F.lit(1), end), gap, F.substring(raw, end + 1, F.greatest(F.length(raw) - end, F.lit(0))))
        out = out.withColumn("raw", F.when((F.length(raw) >= t.record_length) | (F.length(raw) < end), raw).otherwise(wide))
    return out


def nested_rows(records: DataFrame, path: Sequence[ir.Array], keys: list[ir.Column], counters: Sequence[ir.Column] = (), options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """One row for each element of the last array of a path, each array inside an element of the one before: the record's
    keys, an index from 1 for each array, the element's columns and errors. A counter is a column of the element around
    its array, or one of counters, columns of the record; what an inner counter leaves out keeps its place. Of an array whose
    counter is neither, all places are there."""
    raw, of_record = F.col("raw"), {c.name: c for c in counters}
    others = [x for x in records.columns if x != "raw"]
    counts = {a.counter: decoded(of_record[a.counter], raw, options)[0].alias(f"__n_{a.counter}") for a in path if a.counter in of_record}
    rows = records.select(*others, "raw", *(decoded(k, raw, options)[0].alias(k.name) for k in keys), *counts.values())
    around: dict[str, ir.Column] = {}
    for depth, a in enumerate(path, 1):
        count = None
        if a.counter in around:
            count = decoded(around[a.counter], raw, options)[0]
        elif a.counter in counts:
            count = F.col(f"__n_{a.counter}")
        rows = rows.select(*(c for c in rows.columns if c != "raw"), F.posexplode(elements(a, raw, count)).alias("__at", "raw"))
        rows = rows.withColumn(ir.index_name(depth), (F.col("__at") + 1).cast("short")).drop("__at")
        around = {c.name: c for c in a.columns}
    return decode(rows.drop(*(f"__n_{c}" for c in counts)), path[-1].columns, options, on_error="null")


def rows_within(elements_around: DataFrame, path: Sequence[ir.Array], counters: Sequence[ir.Column] = (), options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """nested_rows() of a path of several arrays from the rows of the array before the last: raw is the whole record, keys and
    indexes are columns."""
    *around, a = path
    raw, others = F.col("raw"), [x for x in elements_around.columns if x != "raw"]
    begin = reduce(lambda x, y: x + y, ((F.col(ir.index_name(k)) - 1) * b.stride + b.offset for k, b in enumerate(around, 1)))
    element, inside, of_record = F.substring(raw, begin + 1, F.lit(around[-1].stride)), {c.name: c for c in around[-1].columns}, {c.name: c for c in counters}
    count = None
    if a.counter in inside:
        count = decoded(inside[a.counter], element, options)[0]
    elif a.counter in of_record:
        count = decoded(of_record[a.counter], raw, options)[0]
    rows = elements_around.select(*others, F.posexplode(elements(a, element, count)).alias("__at", "raw"))
    return decode(rows.withColumn(ir.index_name(len(path)), (F.col("__at") + 1).cast("short")).drop("__at"), a.columns, options, on_error="null")


def child_rows(records: DataFrame, a: ir.Array, keys: list[ir.Column], counter: ir.Column | None = None, options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """One row for each element: the parent's keys, occurrence_index from 1, the element's columns and errors."""
    return nested_rows(records, [a], keys, [counter] if counter else [], options)


def element_structs(a: ir.Array, raw: Column, counter: Column | None = None, options: DecodeOptions = DecodeOptions()) -> Column:
    """array<struct> of the elements' columns and, as arrays of the same kind, of the arrays in them."""

    def of(x: Column) -> Column:
        own = {c.name: c for c in a.columns}
        inner = [element_structs(b, x, decoded(own[b.counter], x, options)[0] if b.counter in own else None, options).alias(b.name) for b in a.arrays]
        return F.struct(*(decoded(c, x, options)[0].alias(c.name) for c in a.columns), *inner)

    return F.transform(elements(a, raw, counter), of)


def wide_columns(a: ir.Array, raw: Column, options: DecodeOptions = DecodeOptions(), most: int | None = None) -> list[Column]:
    """Columns name_1 .. name_n, each at its own element's place."""
    return [decoded(c, raw, options, a.offset + k * a.stride + c.offset)[0].alias(f"{c.name}_{k + 1}") for k in range(most or a.most) for c in a.columns]


def overlay_columns(o: ir.Overlay, raw: Column, options: DecodeOptions = DecodeOptions(), when: Column | None = None) -> list[Column]:
    """The overlay's columns; null where the condition does not hold."""
    value = lambda c: decoded(c, raw, options)[0]
    return [(F.when(when, value(c)) if when is not None else value(c)).alias(c.name) for c in o.columns]


def overlay_json(o: ir.Overlay, raw: Column, options: DecodeOptions = DecodeOptions()) -> Column:
    return F.to_json(F.struct(*overlay_columns(o, raw, options)))
