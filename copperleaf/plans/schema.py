"""From laid-out items to tables and columns: types, keys, checks, arrays and overlays. Driver-side metadata."""

from __future__ import annotations

import dataclasses
import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from copperleaf.plans.copybook import Item
from copperleaf.plans.layout import analyse, lay_out


@dataclass
class SqlType:
    spark: str
    postgres: str
    sqlserver: str


@dataclass
class Column:
    """A column and how to decode it. scale counts digits after the point; sign: none, overpunch, leading or trailing."""

    name: str
    source: str
    type: SqlType
    offset: int
    length: int
    kind: str  # text, zoned, packed, packed_unsigned, binary, binary_little, float, index, row_number
    scale: int = 0
    precision: int = 0
    signed: bool = False
    sign: str = "overpunch"
    nullable: bool = True
    date_format: str | None = None
    sentinels: list[str] = field(default_factory=list)
    check: list[str] = field(default_factory=list)
    check_names: list[str] = field(default_factory=list)  # of the conditions that the values belong to


@dataclass
class Array:
    """An OCCURS item: element columns have offsets within an element."""

    name: str
    offset: int
    stride: int
    least: int
    most: int
    counter: str | None
    columns: list[Column]
    arrays: list[Array] = field(default_factory=list)


@dataclass
class Overlay:
    """Columns that redefine others, at the same place; length is the longer one's of the two."""

    name: str
    base: str
    columns: list[Column]
    offset: int = 0
    length: int = 0


@dataclass
class Table:
    name: str
    columns: list[Column]
    record_length: int
    kind: str = "main"  # main, occurs_child, redefines_subtype, scalars
    parent: str | None = None
    primary_key: list[str] = field(default_factory=list)
    arrays: list[Array] = field(default_factory=list)
    overlays: list[Overlay] = field(default_factory=list)

    def column(self, name: str) -> Column:
        if (found := next((c for c in self.columns if c.name == name), None)) is None:
            raise ValueError(f"table {self.name} has no column {name}")
        return found

    def struct(self) -> StructType:
        return StructType([StructField(c.name, _parse_datatype_string(c.type.spark), c.nullable, {"source": c.source, "offset": c.offset, "length": c.length, "kind": c.kind}) for c in self.columns])


@dataclass
class Relationship:
    child: str
    parent: str
    columns: list[str]
    name: str


@dataclass
class Schema:
    tables: list[Table]
    relationships: list[Relationship] = field(default_factory=list)

    def table(self, name: str) -> Table:
        """By name, or the first main one."""
        return next((t for t in self.tables if t.name == name), None) or next(t for t in self.tables if t.kind == "main")


def snake(name: str) -> str:
    """A column's name: ASCII letters, digits and underscores as they are, an underscore for anything else between them."""
    kept = [c if c == "_" or c.isascii() and c.isalnum() else "_" for c in name.lower()]
    return "".join(kept).strip("_") or "field"


def index_name(depth: int) -> str:
    """The column that numbers the elements of an array that lies in depth - 1 others."""
    return "occurrence_index" if depth == 1 else f"occurrence_index_{depth}"


def sql_type(item: Item) -> SqlType:
    """The target type of an elementary item. Usage goes before category, so floats need no picture."""
    p = analyse(item.picture)
    n = p.digits + p.decimals
    decimal = lambda s: SqlType(f"decimal({max(n, 1)},{s})", f"NUMERIC({max(n, 1)},{s})", f"DECIMAL({max(n, 1)},{s})")
    ints = SqlType("smallint", "SMALLINT", "SMALLINT") if n <= 4 else SqlType("int", "INTEGER", "INT") if n <= 9 else SqlType("bigint", "BIGINT", "BIGINT")
    if item.usage == "COMP-1":
        return SqlType("float", "REAL", "REAL")
    if item.usage == "COMP-2":
        return SqlType("double", "DOUBLE PRECISION", "FLOAT")
    if item.usage in ("INDEX", "POINTER"):
        return SqlType("bigint", "BIGINT", "BIGINT")
    if p.category != "NUMERIC":
        size = max(1, p.chars or (20 if p.category == "NUMERIC_EDITED" else 1))
        return SqlType("string", f"VARCHAR({size})", f"NVARCHAR({size})")
    if item.usage in ("COMP-3", "PACKED-DECIMAL", "COMP-6") or p.decimals:
        return decimal(p.decimals)
    if item.usage == "DISPLAY" and n > 18:
        return decimal(0)
    return ints


def kind_of(item: Item) -> str:
    match item.usage:
        case "COMP-3" | "PACKED-DECIMAL":
            return "packed"
        case "COMP-6":
            return "packed_unsigned"
        case "COMP" | "COMP-4" | "BINARY":
            return "binary"
        case "COMP-5":
            return "binary_little"
        case "COMP-1" | "COMP-2":
            return "float"
        case "INDEX" | "POINTER":
            return "index"
    return "zoned" if analyse(item.picture).category == "NUMERIC" else "text"


@dataclass
class Options:
    """How a copybook becomes tables. dates, sentinels and keys are given by the items' names."""

    filler: str = "skip"  # skip, warn (and skip), keep
    redefines: str = "wide"  # wide, subtype, json
    occurs: str = "child"  # child, json, wide
    dates: dict[str, str] = field(default_factory=dict)
    sentinels: dict[str, list[str]] = field(default_factory=dict)
    primary_key: dict[str, list[str]] = field(default_factory=dict)


class Analyzer:
    def __init__(self, options: Options | None = None):
        self.options = options or Options()

    def analyse(self, roots: list[Item]) -> Schema:
        schema = Schema([])
        scalars = [r for r in roots if r.level == 77]
        used: dict[str, int] = {}
        for root in roots:
            if root.level == 1:
                end = lay_out([root])
                name = self._unique(snake(root.name), used)
                table = Table(name, [], end)
                self._fill(table, root.children or [root], "", 0)
                self._names(table.columns)
                table.primary_key = self.options.primary_key.get(root.name, [])[:] or [c.name for c in table.columns if c.kind != "text" and c.type.spark != "string"][:1]
                for c in table.columns:
                    c.nullable = c.name not in table.primary_key
                schema.tables.append(table)
                self._derived(schema, table, used)
        if scalars:
            end = lay_out(scalars)
            schema.tables.append(Table("_scalars", [self._column(x, "", 0) for x in scalars], end, "scalars"))
        return schema

    def _unique(self, name: str, used: dict[str, int]) -> str:
        used[name] = used.get(name, -1) + 1
        return f"{name}_{used[name]}" if used[name] else name

    def _column(self, item: Item, prefix: str, base: int) -> Column:
        p = analyse(item.picture)
        sign = (item.sign or "trailing") if item.separate else "overpunch"
        return Column(
            prefix + snake(item.name), item.name, sql_type(item), item.offset - base, item.length, kind_of(item), p.decimals, p.digits + p.decimals,
            p.signed or not item.picture, sign, date_format=self.options.dates.get(item.name), sentinels=self.options.sentinels.get(item.name, []),
            check=[v for c in item.conditions for v in c.values], check_names=[c.name for c in item.conditions for _ in c.values],
        )

    def _fill(self, table: Table | Array, items: list[Item], prefix: str, base: int) -> None:
        for item in items:
            if item.filler and self.options.filler != "keep":
                if self.options.filler == "warn":
                    warnings.warn(f"FILLER at {item.offset} in {getattr(table, 'name', '') or 'a group'} is left out", stacklevel=2)
                continue
            if item.occurs:
                elements = Array(snake(item.name), item.offset - base, item.length, item.occurs.least, item.occurs.most, item.occurs.depending_on and snake(item.occurs.depending_on), [])
                if item.children:
                    self._fill(elements, item.children, "", item.offset)
                else:
                    elements.columns.append(self._column(item, "", item.offset))
                self._names(elements.columns)
                table.arrays.append(elements)
            elif item.redefines and isinstance(table, Table):
                under = next((x.size for x in items if x.name == item.redefines), 0)
                over = Overlay(snake(item.name), snake(item.redefines), [], item.offset - base, max(item.size, under))
                group = Table("", over.columns, 0)
                self._fill(group, item.children or [item], f"{snake(item.name)}_" if item.children and self.options.redefines == "wide" else "", base)
                table.overlays.append(over)
                if self.options.redefines == "wide":
                    table.columns += over.columns
            elif item.children:
                self._fill(table, item.children, prefix, base)
            else:
                table.columns.append(self._column(item, prefix, base))

    def _names(self, columns: list[Column]) -> None:
        """Equal names get numbers, so none hides another."""
        seen: dict[str, int] = {}
        for c in columns:
            seen[c.name] = seen.get(c.name, 0) + 1
            if seen[c.name] > 1:
                c.name = f"{c.name}_{seen[c.name]}"

    def _children(self, schema: Schema, parent: Table, arrays: list[Array], keys: list[Column], used: dict[str, int], depth: int, size: int) -> None:
        """A table for each array, and below it one for each array in its elements, which refers to it."""
        number = SqlType("smallint", "SMALLINT", "SMALLINT")
        for a in arrays:
            name = self._unique(f"{parent.name}_{a.name}", used)
            index = Column(index_name(depth), "", number, 0, 0, "row_number", nullable=False)
            own = [dataclasses.replace(k, nullable=False) for k in keys]
            taken = {k.name for k in own} | {index.name}
            for c in a.columns:
                while c.name in taken:  # a key or an index has the name
                    c.name += "_2"
                taken.add(c.name)
            child = Table(name, [*own, index, *a.columns], size, "occurs_child", parent.name, [*(k.name for k in own), index.name])
            schema.tables.append(child)
            if keys:
                schema.relationships.append(Relationship(name, parent.name, [k.name for k in own], f"fk_{name}_{parent.name}"))
            self._children(schema, child, a.arrays, [*own, index], used, depth + 1, size)

    def _derived(self, schema: Schema, table: Table, used: dict[str, int]) -> None:
        if self.options.occurs == "child":
            self._children(schema, table, table.arrays, [table.column(k) for k in table.primary_key], used, 1, table.record_length)
        for a in table.arrays if self.options.occurs == "wide" else []:
            table.columns += [dataclasses.replace(c, name=f"{c.name}_{k + 1}", offset=a.offset + k * a.stride + c.offset) for k in range(a.most) for c in a.columns]
        json_type = SqlType("string", "JSONB", "NVARCHAR(MAX)")
        for a in table.arrays if self.options.occurs == "json" else []:
            table.columns.append(Column(f"{a.name}_array", a.name, json_type, a.offset, a.stride * a.most, "array"))
        for o in table.overlays:
            if self.options.redefines == "json":
                table.columns.append(Column(f"{o.name}_json", o.name, json_type, min(c.offset for c in o.columns), 0, "overlay"))
            if self.options.redefines == "subtype":
                base = [c for c in table.columns if not o.offset <= c.offset < o.offset + o.length]
                schema.tables.append(Table(self._unique(f"{table.name}_{o.name}", used), [*base, *o.columns], table.record_length, "redefines_subtype", table.name))


def to_json(schema: Schema) -> str:
    return json.dumps(dataclasses.asdict(schema))


def from_json(text: str) -> Schema:
    def column(x: dict) -> Column:
        return Column(**x | {"type": SqlType(**x["type"])})

    def array(x: dict) -> Array:
        return Array(**x | {"columns": [column(c) for c in x["columns"]], "arrays": [array(a) for a in x["arrays"]]})

    def table(x: dict) -> Table:
        overlays = [Overlay(**o | {"columns": [column(c) for c in o["columns"]]}) for o in x["overlays"]]
        return Table(**x | {"columns": [column(c) for c in x["columns"]], "arrays": [array(a) for a in x["arrays"]], "overlays": overlays})

    x = json.loads(text)
    return Schema([table(t) for t in x["tables"]], [Relationship(**r) for r in x["relationships"]])


def compile_copybook(text: str, options: Options | None = None, folders: list[str] | None = None, free: bool = False) -> Schema:
    from copperleaf.plans.copybook import parse

    return Analyzer(options).analyse(parse(text, folders or (), free))
