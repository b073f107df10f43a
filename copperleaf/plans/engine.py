"""A run from copybook and files to loaded tables, with state, rejections and validation."""

from __future__ import annotations

import dataclasses
import json
import warnings
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperleaf.operators import load as loading
from copperleaf.operators import reconcile, subtypes
from copperleaf.operators.decode import DecodeOptions, decode
from copperleaf.operators.reshape import element_structs, full_layout, nested_rows, of_table, overlay_json, routed, rows_within
from copperleaf.plans import ddl
from copperleaf.plans.copybook import program_facts
from copperleaf.plans.schema import Array, Options, Schema, Table, compile_copybook, snake
from copperleaf.plans.state import Store
from copperleaf.sources import records


@dataclass
class Source:
    path: str
    recfm: str = "F"
    record_length: int | None = None
    skip: int = 0
    table: str | None = None
    route: tuple[int, int, dict[str, str]] | None = None  # offset, length, values to tables
    unmatched: str = "default"  # default, skip
    discriminate: bool = False  # find the route to the tables of overlays (options.redefines "subtype") from the records


@dataclass
class RunConfig:
    project: str
    copybook: str
    sources: list[Source]
    target: str
    state: str
    mode: str = "truncate_load"
    on_error: str = "reject"  # reject, null
    options: Options = field(default_factory=Options)
    free: bool = False  # the copybook's lines have no columns of their own
    decoding: DecodeOptions = field(default_factory=DecodeOptions)
    program: str | None = None  # text of a program that tests the fields

    def __post_init__(self) -> None:
        for value, known in ((self.mode, loading.MODES), (self.on_error, ("reject", "null")), *((s.unmatched, ("default", "skip")) for s in self.sources)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")


def checks_of(t: Table) -> tuple[loading.Check, ...]:
    return tuple(loading.Check(f"chk_{t.name}_{c.name}", c.name, tuple(c.check)) for c in t.columns if c.check)


@lru_cache(maxsize=64)
def _compiled(text: str, options: str, free: bool) -> Schema:
    return compile_copybook(text, Options(**json.loads(options)), free=free)


def compiled(text: str, options: Options | None = None, free: bool = False) -> Schema:
    """A copybook's schema; of equal texts and options it is worked out once."""
    return _compiled(text, json.dumps(dataclasses.asdict(options or Options()), sort_keys=True), free)


def with_derived(rows: DataFrame, t: Table, decoding: DecodeOptions) -> DataFrame:
    """rows (with __raw) with the JSON columns that stand for arrays and overlays of a table."""
    raw, columns = F.col("__raw"), {}
    for c in t.columns:
        if c.kind == "array":
            a = next(a for a in t.arrays if a.name == snake(c.source))
            columns[c.name] = F.to_json(element_structs(a, raw, F.col(a.counter) if a.counter else None, decoding))
        elif c.kind == "overlay":
            columns[c.name] = overlay_json(next(o for o in t.overlays if o.name == snake(c.source)), raw, decoding)
    good = F.size("errors") == 0
    return rows.withColumns({k: F.when(good, x) for k, x in columns.items()}) if columns else rows


def children_of(schema: Schema, t: Table, arrays: list[Array] | None = None, path: tuple[Array, ...] = ()) -> list[tuple[Table, tuple[Array, ...]]]:
    """The tables of a table's arrays with the arrays that lead there, those of arrays inside others after theirs."""
    out = []
    own = [x for x in schema.tables if x.kind == "occurs_child" and x.parent == t.name]
    for child, a in zip(own, t.arrays if arrays is None else arrays, strict=False):
        out += [(child, (*path, a)), *children_of(schema, child, a.arrays, (*path, a))]
    return out


def extracted(spark: SparkSession, schema: Schema, source: Source, config: RunConfig) -> dict[str, tuple[Table, DataFrame]]:
    """For each table of the source, its decoded rows with __file, __line_num, __raw and errors; child tables after theirs."""
    rows = records.read_records(spark, source.path, source.recfm, source.record_length or schema.table(source.table or "").record_length, source.skip)
    rows = rows.withColumnsRenamed({"file": "__file", "line_num": "__line_num"})  # a copybook may have fields of these names
    route, first = source.route, schema.table("").name
    if route is None and source.discriminate:
        t = schema.table(source.table or "")
        rows, first = full_layout(rows, t, config.decoding), t.name
        tested = [name.upper() for name, _ in program_facts(config.program, config.free)["tested"]] if config.program else []
        route = subtypes.route_of(rows, t, [x.name for x in schema.tables if x.kind == "redefines_subtype" and x.parent == t.name], config.decoding, tested)
        if route is None:
            warnings.warn(f"no field tells the layouts of {t.name} apart; all records go to that table", stacklevel=2)
    if route:
        offset, length, types = route
        default = first if source.unmatched == "default" else None
        rows = routed(rows, offset, length, types, default, config.decoding)
        parts = {n: of_table(rows, n).drop("table_name") for n in dict.fromkeys([*types.values(), *([default] if default else [])])}
    else:
        parts = {schema.table(source.table or "").name: rows}
    known, out = {t.name: t for t in schema.tables}, {}
    for name, r in parts.items():
        if (t := known.get(name)) is None:
            continue
        r = full_layout(r, t, config.decoding)
        r = r.withColumn("__raw", F.col("raw"))
        out[name] = t, with_derived(decode(r, t, config.decoding, config.on_error), t, config.decoding)
        for child, path in children_of(schema, t):
            out[child.name] = child, nested_rows(r, path, [t.column(k) for k in t.primary_key], t.columns, config.decoding)
    return out


def place_of(t: Table) -> list[str]:
    """Columns that tell the record that a row came from, and its element."""
    return ["__file", "__line_num", *(c.name for c in t.columns if c.kind == "row_number")]


def lost(rows: DataFrame, refused: DataFrame, t: Table, config: RunConfig) -> DataFrame:
    """place_of() and reason of the records of a table (or elements of an array) that have no row of their own in the
    target: undecodable ones, refused ones, and, for upserts, those that a later record of their key replaces. rows: all
    decoded ones."""
    place = place_of(t)
    own = refused.select(*place, F.col("reject_reason").alias("reason"))
    good = rows
    if config.on_error == "reject":
        good = rows.where(F.size("errors") == 0)
        bad = rows.where(F.size("errors") > 0)
        own = own.unionAll(bad.select(*place, F.concat(F.get("errors", F.lit(0))["column"], F.lit(": "), F.get("errors", F.lit(0))["message"])))
    if config.mode == "upsert" and t.primary_key:
        last = F.row_number().over(Window.partitionBy(*t.primary_key).orderBy(F.desc("__file"), F.desc("__line_num")))
        fine = good.join(refused.select(*place), place, "left_anti")
        replaced = fine.select(*place, last.alias("n")).where("n > 1")
        own = own.unionAll(replaced.select(*place, F.lit("replaced by a later record")))
    return own


def with_parents(rows: DataFrame, parent: Table, gone: DataFrame | None, target: str) -> DataFrame:
    """Rows of a child table with the reason why they can't land (loading.REFUSED): their record has no row in the parent's
    table, or, by key, no row there refers to."""
    reason = F.lit(None).cast("string")
    if gone is not None:
        place = place_of(parent)
        why = gone.groupBy(*place).agg(F.min("reason").alias("__why"))
        rows = rows.join(why, place, "left")
        reason = F.when(F.col("__why").isNotNull(), F.concat(F.lit(f"{parent.name}: "), "__why"))
    if parent.primary_key:
        there = rows.sparkSession.read.parquet(f"{target}/{parent.name}").select(*parent.primary_key).distinct().withColumn("__there", F.lit(True))
        rows = rows.join(there, parent.primary_key, "left")
        reason = F.coalesce(reason, F.when(F.col("__there").isNull(), F.lit(f"no row in {parent.name}")))
    return rows.withColumn(loading.REFUSED, reason).drop("__why", "__there")


def with_reasons(rows: DataFrame, t: Table, refused: DataFrame, path: str, config: RunConfig) -> DataFrame:
    """Decoded rows of a table that this run loaded, with the reason why they have no row in the target (loading.REFUSED): what
    lost() says of them, without a join. Only repeated keys, of which most files have few, are looked up by their places."""
    reason = loading.judged(rows, t.primary_key or None, checks_of(t))
    if config.on_error == "reject":
        first = F.get("errors", F.lit(0))
        reason = reason.withColumn("reject_reason", F.when(F.size("errors") > 0, F.concat(first["column"], F.lit(": "), first["message"])).otherwise(F.col("reject_reason")))
    if t.kind != "occurs_child":  # the rows of an array differ in their index, and repeated records have a reason
        place = place_of(t)
        refused.where(F.col("reject_reason") == loading.DUPLICATE).select(*place).write.parquet(path)
        repeated = rows.sparkSession.read.schema(refused.select(*place).schema).parquet(path)
        if not repeated.isEmpty():
            reason = reason.join(repeated.withColumn("__again", F.lit(True)), place, "left")
            reason = reason.withColumn("reject_reason", F.when(F.col("__again"), F.lit(loading.DUPLICATE)).otherwise(F.col("reject_reason"))).drop("__again")
    return reason.withColumnRenamed("reject_reason", loading.REFUSED)


def from_parents(rows: DataFrame, root: Table, parent: Table, path: tuple[Array, ...], config: RunConfig) -> DataFrame:
    """Decoded rows of a child table, made of its parent's (with_reasons), so that each brings its parent's reason along."""
    keys = parent.primary_key if parent.kind == "occurs_child" else []
    why = F.when(F.col(loading.REFUSED).isNotNull(), F.concat(F.lit(f"{parent.name}: "), loading.REFUSED)).alias(loading.REFUSED)
    own = rows.select("__file", "__line_num", "__raw", why, *keys, F.col("__raw").alias("raw"))
    if parent.kind == "occurs_child":
        return rows_within(own, path, root.columns, config.decoding)
    return nested_rows(own, path, [root.column(k) for k in root.primary_key], root.columns, config.decoding)


def run(spark: SparkSession, config: RunConfig) -> str:
    """Loads every source whose checksum is not already loaded; returns the run's id. A failing table fails alone, and the
    run is failed then; a cancelled run takes no further table. What is decoded is written once, then counted, logged and
    loaded from there. A child's rows land with their parent: where that was refused, they are, with its reason; where the
    parent's table failed, theirs does. They are made of their parent's rows where this run loads both, so neither parents nor
    keys are joined."""
    schema, store = compiled(config.copybook, config.options, config.free), Store(spark, config.state)
    run_id, failed = store.start_run(config.project), []
    for source in config.sources:
        checksum = records.source_checksum(spark, source.path, source.recfm, source.record_length or schema.table(source.table or "").record_length)
        tables, gone, reasons = extracted(spark, schema, source, config), {}, {}
        paths = {child.name: (t, path) for t, _ in tables.values() if t.kind != "occurs_child" for child, path in children_of(schema, t)}
        for name, (t, rows) in tables.items():
            if store.status(run_id) == "cancelled":
                loading.remove(spark, f"{store.path('staged')}/{run_id}")
                return run_id
            if store.completed(config.project, name, checksum):
                continue
            state = store.start_table(run_id, name, checksum)
            staged, refused = (f"{store.path('staged')}/{run_id}/{state}-{x}" for x in ("decoded", "refused"))
            try:
                around = t.parent if t.kind == "occurs_child" else None
                if around in failed:
                    raise ValueError(f"the parent's table {t.parent} failed")
                columns, order = [c.name for c in t.columns], ["__file", "__line_num"]  # arrival order decides between equal keys
                if around in reasons:
                    rows, order = from_parents(reasons[around], paths[name][0], tables[around][0], paths[name][1], config), None
                rows.write.parquet(staged)
                rows = spark.read.schema(rows.schema).parquet(staged)
                bad = rows.where(F.size("errors") > 0)
                store.log_rejections(run_id, state, bad.select(F.col("__line_num").alias("line_num"), F.col("__raw").alias("raw"), "errors"))
                n_bad = bad.count() if config.on_error == "reject" else 0
                good = rows.where(F.size("errors") == 0) if config.on_error == "reject" else rows
                good = good.drop("errors")
                if around in tables and around not in reasons:
                    good = with_parents(good, tables[around][0], gone.get(around), config.target)
                stats = loading.load(good, f"{config.target}/{name}", config.mode, t.primary_key or None, checks_of(t), order, refused, columns)
                if any(x.parent == name and x.kind == "occurs_child" for x, _ in tables.values()):
                    without, own = f"{store.path('staged')}/{run_id}/{state}-lost", spark.read.parquet(refused)
                    if config.mode != "upsert" and t.primary_key and (t.kind != "occurs_child" or around in reasons):
                        reasons[name] = with_reasons(rows, t, own, without, config)
                    else:
                        lost(rows, own, t, config).write.parquet(without)
                        gone[name] = spark.read.parquet(without)
                store.log_refusals(run_id, state, spark.read.parquet(refused).withColumnsRenamed({"__line_num": "line_num", "__raw": "raw"}).drop("__file"))
                store.finish_table(state, stats["loaded"] + stats["rejected"] + n_bad, stats["loaded"], stats["rejected"] + n_bad)
                store.tell(run_id, "table_progress", name, stats["loaded"], stats["rejected"] + n_bad)
            except Exception as e:
                failed.append(name)
                store.finish_table(state, 0, 0, 0, "failed", str(e)[:2000])
                store.tell(run_id, "table_progress", name)
            if name not in reasons:  # children are made of what is staged
                for path in (staged, refused):
                    loading.remove(spark, path)
        loading.remove(spark, f"{store.path('staged')}/{run_id}")
    store.finish_run(run_id, "failed" if failed else "completed", f"failed: {', '.join(failed)}" if failed else None)
    store.tell(run_id, "run_complete")
    return run_id


def validate(spark: SparkSession, config: RunConfig, run_id: str, most: float = reconcile.RATE) -> DataFrame:
    """check, table_name, passed for a run: rows extracted against rows loaded and rejected, the rate of rejections, and the
    rows that are in the target, for each table; and whether all tables completed."""
    store = Store(spark, config.state)
    states = store.latest("table_migration_states").where(F.col("run_id") == run_id)
    parts = [
        reconcile.count_check(states).select(F.lit("row_count").alias("check"), "table_name", "passed"),
        reconcile.rate_check(states, most).select(F.lit("rejection_rate").alias("check"), "table_name", "passed"),
        states.select(F.lit("completed").alias("check"), "table_name", (F.col("status") == "completed").alias("passed")),
    ]
    if config.mode == "truncate_load":
        for name in [r.table_name for r in states.where("status = 'completed'").select("table_name").distinct().collect()]:  # tables of one copybook
            there = spark.read.parquet(f"{config.target}/{name}").count()
            own = states.where(F.col("table_name") == name).agg(F.max_by("rows_loaded", "finished_at").alias("loaded"))
            parts.append(own.select(F.lit("in_target").alias("check"), F.lit(name).alias("table_name"), (F.col("loaded") == there).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def preview(spark: SparkSession, config: RunConfig, n: int = 10) -> DataFrame:
    """The first decoded rows of the first source's table."""
    schema = compiled(config.copybook, config.options, config.free)
    t, rows = next(iter(extracted(spark, schema, config.sources[0], config).values()))
    return rows.orderBy("__file", "__line_num").select(*(c.name for c in t.columns), "errors").limit(n)


def ddl_of(copybook: str, dialect: str = "postgres", options: Options | None = None) -> str:
    return ddl.script(compiled(copybook, options), dialect)
