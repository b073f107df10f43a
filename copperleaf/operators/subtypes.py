"""Which layout of a redefined area (REDEFINES) a record has: the field that tells is found from the data, and from what
programs test.

Every layout states how likely the bytes of an area are: a digit is one of ten, a character one of some hundred, what
does not decode costs all its bits. For each candidate field, each of its values gets the layout in which its records
take the fewest bits; the field that makes all records shortest, its list of values included, is the one that tells.
All records count, in one aggregate over (field, value); the driver sees one row a field and at most `most` values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.operators.decode import DecodeOptions, base, decoded, once, separate_sign, text_of
from copperleaf.plans import schema as ir

#: Costs are whole numbers, thousandths of a bit, so that sums do not depend on their order.
BIT = 1000
#: Characters that a text may be made of, about.
CHARACTERS = 96


@dataclass
class Area:
    """A redefined place in the record, with the overlays that lie there."""

    offset: int
    length: int
    overlays: list[ir.Overlay]


@dataclass
class Found:
    """The field that tells the layouts apart: values of it with the position of their layout, 0 for the base's."""

    column: ir.Column
    layouts: dict[str, int]


def areas(t: ir.Table) -> list[Area]:
    """The redefined areas of a table, in the order of their offsets."""
    out: dict[int, Area] = {}
    for o in t.overlays:
        area = out.setdefault(o.offset, Area(o.offset, 0, []))
        area.length = max(area.length, o.length)
        area.overlays.append(o)
    return [out[k] for k in sorted(out)]


def layouts(t: ir.Table, area: Area) -> list[list[ir.Column]]:
    """The columns of the area in each of its layouts, the redefined item's own first."""
    over = [c for o in t.overlays for c in o.columns]
    own = [c for c in t.columns if c not in over and c.length and area.offset <= c.offset < area.offset + area.length]
    return [own, *(o.columns for o in area.overlays)]


def candidates(t: ir.Table, named: Iterable[str] = (), longest: int = 8) -> list[ir.Column]:
    """Fields outside all redefined areas whose characters may tell a record's type: short ones, and those that a program
    tests (named, as the copybook has them) or that have condition names."""
    over, tested = [c for o in t.overlays for c in o.columns], set(named)
    inside = lambda c: any(a.offset <= c.offset < a.offset + a.length for a in areas(t))
    fit = [c for c in t.columns if c.kind in ("text", "zoned") and c.length and not c.date_format and c not in over and not inside(c)]
    return [c for c in fit if c.length <= longest or c.source in tested or c.check]


def bits(c: ir.Column, raw: Column, options: DecodeOptions) -> Column:
    """What a column's bytes cost, by how few of all bytes its format allows; a byte's eight bits each where they don't fit."""
    f, n = codecs.slice_of(raw, c.offset, c.length), c.length
    digit = math.log2(10)
    match c.kind:
        case _ if c.date_format:
            fits, cost = decoded(c, raw, options)[0].isNotNull(), n * digit
        case "packed":
            fits, cost = F.hex(f).rlike(f"^[0-9]{{{2 * n - 1}}}[A-F]$"), (2 * n - 1) * digit + math.log2(6)
        case "packed_unsigned":
            fits, cost = F.hex(f).rlike(f"^[0-9]{{{2 * n}}}$"), 2 * n * digit
        case "zoned":
            digits = codecs.zoned_parts(base(c, f, options), n, c.signed, separate=separate_sign(c))[1]
            fits, cost = digits.rlike("^[0-9]+$"), n * digit + c.signed
        case "text":
            fits, cost = ~text_of(f, options, strip=False).rlike(r"[\p{Cntrl}\x{FFFD}]"), n * math.log2(CHARACTERS)
        case _:
            return F.lit(8 * BIT * n)
    whole = F.length(raw) >= c.offset + n
    return F.when(whole & F.coalesce(fits, F.lit(False)), F.lit(round(cost * BIT))).otherwise(F.lit((8 * n + 1) * BIT))


def costs(records: DataFrame, t: ir.Table, area: Area, fields: list[ir.Column], options: DecodeOptions = DecodeOptions()) -> DataFrame:
    """field (its position among fields), value, n, cost_0, cost_1, ...: for every value of a field the number of records
    and what their areas cost in each layout. Records that end before the area don't count."""
    raw, shapes = F.col("raw"), layouts(t, area)
    value = lambda c: codecs.stripped(text_of(codecs.slice_of(raw, c.offset, c.length), options))
    values = F.array(*(F.struct(F.lit(i).alias("field"), value(c).alias("value")) for i, c in enumerate(fields)))
    spare = lambda shape: 8 * BIT * max(0, area.length - sum(c.length for c in shape))
    each = [reduce(add, (bits(c, raw, options) for c in shape), F.lit(spare(shape))).cast("long").alias(f"cost_{k}") for k, shape in enumerate(shapes)]
    rows = once(records.where(F.length(raw) > area.offset).select(values.alias("values"), *each))
    names = [f"cost_{k}" for k in range(len(shapes))]
    return rows.select(F.inline("values"), *names).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in names))


def judged(totals: DataFrame) -> DataFrame:
    """costs() with layout, the cheapest one of each value (of equal ones the first), and best, what it costs."""
    names = [c for c in totals.columns if c.startswith("cost_")]
    best = F.least(*names)
    return totals.withColumns({"best": best, "layout": (F.array_position(F.array(*names), best) - 1).cast("int")})


def discriminator(records: DataFrame, t: ir.Table, area: Area | None = None, options: DecodeOptions = DecodeOptions(), named: Iterable[str] = (), longest: int = 8, most: int = 64) -> Found | None:
    """The field of a table whose values tell the layouts of an area (the first one, if none is given) apart; None where no
    field with up to most values makes the records shorter than one layout for all of them does. Fields that programs test
    or that have condition names go before all others. Equal fields: the one that comes first in the record."""
    area = area or next(iter(areas(t)), None)
    named = set(named)
    fields = candidates(t, named, longest)
    if area is None or not fields:
        return None
    names = [f"cost_{k}" for k in range(len(area.overlays) + 1)]
    rows = judged(costs(records, t, area, fields, options))
    sums = rows.groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.sum("best").alias("best"), F.min("layout").alias("low"), F.max("layout").alias("high"), *(F.sum(x).alias(x) for x in names))
    choice = math.log2(len(names))
    ranked = []
    for r in sums.collect():  # a row for each field
        c = fields[r.field]
        listed = round(BIT * r["values"] * (8 * c.length + choice))
        if r["values"] <= most and r.low < r.high and r.best + listed < min(r[x] for x in names):
            ranked.append((c.source not in named and not c.check, r.best + listed, c.offset, r.field))
    if not ranked:
        return None
    c = fields[min(ranked)[-1]]
    held = judged(costs(records, t, area, [c], options)).where("value is not null").select("value", "layout").collect()  # most rows at most
    return Found(c, {r.value: r.layout for r in sorted(held)})


def route_of(records: DataFrame, t: ir.Table, tables: list[str], options: DecodeOptions = DecodeOptions(), named: Iterable[str] = ()) -> tuple[int, int, dict[str, str]] | None:
    """offset, length and values with their tables, as routed() takes them, for the first area with a field that tells.
    tables: those of the table's overlays, in their order."""
    of = dict(zip((o.name for o in t.overlays), tables, strict=True))
    for area in areas(t):
        if found := discriminator(records, t, area, options, named):
            names = [t.name, *(of[o.name] for o in area.overlays)]
            return found.column.offset, found.column.length, {v: names[k] for v, k in found.layouts.items()}
    return None
