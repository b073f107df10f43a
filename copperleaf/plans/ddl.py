"""CREATE TABLE text for PostgreSQL, SQL Server and Spark."""

from __future__ import annotations

from copperleaf.plans.schema import Schema, Table

SPACE = {"postgres": "public", "sqlserver": "dbo", "spark": "default"}


def quoted(name: str, dialect: str) -> str:
    left, right = {"postgres": '""', "sqlserver": "[]", "spark": "``"}[dialect]
    return f"{left}{name.replace(right, right * 2)}{right}"


def type_text(column, dialect: str) -> str:
    return getattr(column.type, dialect) if dialect != "spark" else column.type.spark.upper()


def literal(value: str, numeric: bool) -> str:
    return value if numeric else "'" + value.replace("'", "''") + "'"


def create_table(table: Table, dialect: str = "postgres", space: str | None = None, comments: bool = False) -> str:
    """One statement. A comment stands on a line of its own above its column."""
    q = lambda x: quoted(x, dialect)
    parts = []
    for c in table.columns:
        note = f"  -- {c.source} at {c.offset}, {c.length} bytes\n" if comments and c.source else ""
        parts.append(f"{note}  {q(c.name)} {type_text(c, dialect)}{'' if c.nullable else ' NOT NULL'}")
    if dialect != "spark":
        if table.primary_key:
            parts.append(f"  CONSTRAINT {q(f'pk_{table.name}')} PRIMARY KEY ({', '.join(map(q, table.primary_key))})")
        for c in table.columns:
            if c.check:
                values = ", ".join(literal(v, c.type.spark != "string") for v in c.check)
                parts.append(f"  CONSTRAINT {q(f'chk_{table.name}_{c.name}')} CHECK ({q(c.name)} IN ({values}))")
    there = "" if dialect == "sqlserver" else "IF NOT EXISTS "
    tail = " USING parquet" if dialect == "spark" else ""
    body = ",\n".join(parts)
    return f"CREATE TABLE {there}{q(space or SPACE[dialect])}.{q(table.name)} (\n{body}\n){tail};"


def lookup_tables(table: Table, dialect: str = "postgres", space: str | None = None) -> list[str]:
    """For each column with named conditions, a table of its values and their names, filled where it is created."""
    q, space, out = (lambda x: quoted(x, dialect)), space or SPACE[dialect], []
    there, tail = ("" if dialect == "sqlserver" else "IF NOT EXISTS "), (" USING parquet" if dialect == "spark" else "")
    name_type = {"postgres": "VARCHAR(64)", "sqlserver": "NVARCHAR(64)", "spark": "STRING"}[dialect]
    for c in table.columns:
        if c.check:
            name = f"{q(space)}.{q(f'{table.name}_{c.name}_values')}"
            key = "" if dialect == "spark" else " PRIMARY KEY"
            pairs = {v: n for v, n in zip(c.check, c.check_names, strict=True)}
            rows = ", ".join(f"({literal(v, c.type.spark != 'string')}, {literal(n, False)})" for v, n in pairs.items())
            out.append(f"CREATE TABLE {there}{name} ({q('value')} {type_text(c, dialect)}{key}, {q('name')} {name_type}){tail};\nINSERT INTO {name} ({q('value')}, {q('name')}) VALUES {rows};")
    return out


def script(schema: Schema, dialect: str = "postgres", space: str | None = None, comments: bool = False, lookups: bool = False) -> str:
    """Lookup tables where they are asked for, all tables, parents first, then foreign keys."""
    q, space = (lambda x: quoted(x, dialect)), space or SPACE[dialect]
    tables = sorted(schema.tables, key=lambda t: t.kind == "occurs_child")
    out = [x for t in tables if t.kind == "main" for x in lookup_tables(t, dialect, space)] if lookups else []
    out += [create_table(t, dialect, space, comments) for t in tables]
    for r in schema.relationships if dialect != "spark" else []:
        columns = ", ".join(map(q, r.columns))
        out.append(f"ALTER TABLE {q(space)}.{q(r.child)} ADD CONSTRAINT {q(r.name)} FOREIGN KEY ({columns}) REFERENCES {q(space)}.{q(r.parent)} ({columns});")
    return "\n\n".join(out) + "\n"


def migration_name(version: str, description: str) -> str:
    return f"V{version}__{description.strip().replace(' ', '_')}.sql"
