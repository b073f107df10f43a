"""Runs, table states and rejections as append-only Parquet tables; the last row of an id is what holds.

One driver writes; a write is one Parquet commit. Reads are ordinary DataFrames.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperleaf.operators import load
from copperleaf.sources import records

TABLES = {
    "projects": "id string, name string, description string, source_type string, target_type string, config_json string, created_at timestamp, updated_at timestamp",
    "copybooks": "id string, project_id string, filename string, file_path string, file_checksum string, parsed_at timestamp, schema_ir string, parse_errors string, created_at timestamp",
    "source_files": "id string, project_id string, copybook_id string, filename string, file_path string, file_checksum string, record_format string, record_length int, encoding string, total_records long, created_at timestamp",
    "migration_runs": "id string, project_id string, run_number int, run_type string, status string, started_at timestamp, finished_at timestamp, rows_extracted long, rows_loaded long, rows_rejected long, error_message string, config_snapshot string, cdc_offset string, written_at timestamp",
    "table_migration_states": "id string, run_id string, table_name string, status string, rows_extracted long, rows_loaded long, rows_rejected long, source_checksum string, error_message string, validation_json string, started_at timestamp, finished_at timestamp, written_at timestamp",
    "progress_events": "id string, run_id string, table_name string, event string, rows_loaded long, rows_rejected long, created_at timestamp",
    "rejection_log": "id string, run_id string, table_state_id string, source_line_num long, raw_bytes binary, decoded_partial string, error_type string, error_message string, created_at timestamp",
}
MAX_REJECTIONS = 1000
#: Which rows a row owns: deleting it deletes them. Table, column that names the owner, table of the owner.
OWNED = (
    ("copybooks", "project_id", "projects"),
    ("source_files", "project_id", "projects"),
    ("migration_runs", "project_id", "projects"),
    ("table_migration_states", "run_id", "migration_runs"),
    ("progress_events", "run_id", "migration_runs"),
    ("rejection_log", "run_id", "migration_runs"),
)
STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


# --- queries over state tables --------------------------------------------------------------------------------------


def run_summary(states: DataFrame) -> DataFrame:
    """Per run: rows, tables, tables completed and failed, elapsed seconds (till now while one is open)."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    end = F.when(F.count_if(F.col("finished_at").isNull()) > 0, F.current_timestamp()).otherwise(F.max(F.col("finished_at").cast("timestamp")))
    return states.groupBy("run_id").agg(
        total("rows_extracted"), total("rows_loaded"), total("rows_rejected"),
        F.count(F.lit(1)).alias("tables"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        (end.cast("long") - F.min(F.col("started_at").cast("timestamp")).cast("long")).alias("elapsed_s"),
    )


def next_run_numbers(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, next_number: one more than the highest, 1 without runs."""
    top = runs.groupBy("project_id").agg(F.max("run_number").alias("top"))
    return projects.join(top, "project_id", "left").select("project_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_number"))


def not_loaded(files: DataFrame, states: DataFrame) -> DataFrame:
    """files (project_id, table_name, checksum) that no completed state has: what a run still has to read."""
    done = states.where("status = 'completed'").select("project_id", "table_name", F.col("source_checksum").alias("checksum"))
    return files.join(done, ["project_id", "table_name", "checksum"], "left_anti")


def rejections_page(log: DataFrame, run: str, limit: int = 200) -> DataFrame:
    return log.where(F.col("run_id") == run).orderBy("created_at", "source_line_num", "id").limit(min(limit, MAX_REJECTIONS))


def progress(states: DataFrame) -> DataFrame:
    """run_id, percent of its tables that are done, 0 without tables."""
    n = F.count(F.lit(1))
    return states.groupBy("run_id").agg(F.round(F.count_if(F.col("status") == "completed") / n * 100).cast("int").alias("percent"))


def without(tables: dict[str, DataFrame], table: str, id: str) -> dict[str, DataFrame]:
    """The tables without a row and all that it owns, directly or through other rows: one anti-join for each table."""
    gone = {table: tables[table].where(F.col("id") == id).select("id").distinct()}
    for child, column, owner in OWNED:
        if owner in gone and child in tables:
            gone[child] = tables[child].join(gone[owner].withColumnRenamed("id", column), column, "left_semi").select("id").distinct()
    return {t: df.join(gone[t], "id", "left_anti") if t in gone else df for t, df in tables.items()}


def recent_runs(runs: DataFrame, project: str, n: int = 5) -> DataFrame:
    """The project's last runs, the latest first."""
    return runs.where(F.col("project_id") == project).orderBy(F.desc("run_number"), F.desc("started_at")).limit(n)


# --- the store ------------------------------------------------------------------------------------------------------


class Store:
    """State tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def add(self, table: str, **values) -> str:
        row = {c.split()[0]: None for c in TABLES[table].split(", ")} | {"id": uuid.uuid4().hex} | values
        stamp = "written_at" if "written_at" in row else "created_at"
        row[stamp] = row.get(stamp) or now()
        self.spark.createDataFrame([tuple(row.values())], TABLES[table]).coalesce(1).write.mode("append").parquet(self.path(table))
        return row["id"]

    def rows(self, table: str) -> DataFrame:
        """All rows, none before the first write."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def latest(self, table: str) -> DataFrame:
        """The last row of each id."""
        stamp = "written_at" if "written_at" in TABLES[table] else "created_at"
        n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(stamp)))
        return self.rows(table).withColumn("__n", n).where("__n = 1").drop("__n")

    def change(self, table: str, id: str, **values) -> None:
        old = self.latest(table).where(F.col("id") == id).first()
        if old is None:
            raise KeyError(id)
        stamp = {"written_at": now()} if "written_at" in TABLES[table] else {"created_at": now()}
        self.add(table, **(old.asDict() | values | stamp))

    def delete(self, table: str, id: str) -> None:
        """Deletes a row with all that it owns."""
        old = {t: self.rows(t) for t in TABLES}
        new = without(old, table, id)
        for t in TABLES:
            if new[t] is not old[t] and load._exists(self.spark, self.path(t)):
                staged = f"{self.path(t)}__staged"
                new[t].select(*old[t].columns).write.mode("overwrite").parquet(staged)
        for t in TABLES:
            if load._exists(self.spark, f"{self.path(t)}__staged"):
                load._take_place(self.spark, self.path(t), f"{self.path(t)}__staged")

    def add_project(self, name: str, **values) -> str:
        return self.add("projects", name=name, **values)

    def update_project(self, id: str, **values) -> None:
        """Changes what is given and isn't None."""
        self.change("projects", id, **{k: v for k, v in values.items() if v is not None}, updated_at=now())

    def add_copybook(self, project: str, path: str, schema_ir: str | None = None) -> str:
        """Registers a copybook's file with its checksum, the text read by Spark."""
        [row] = records.checksums(records.files(self.spark, path)).collect()  # one file
        return self.add("copybooks", project_id=project, filename=path.rsplit("/", 1)[-1], file_path=path, file_checksum=row.checksum, schema_ir=schema_ir, parsed_at=now() if schema_ir else None)

    def add_sources(self, project: str, path: str, recfm: str, record_length: int | None = None, encoding: str = "cp037", copybook: str | None = None) -> None:
        """Registers every file at a path: one row each, written by the executors, with checksum and, for F, its records."""
        f = records.files(self.spark, path)
        total = F.expr(f"length div {record_length}") if record_length else F.lit(None).cast("long")
        given = {"id": F.expr("uuid()"), "project_id": F.lit(project), "copybook_id": F.lit(copybook), "filename": F.element_at(F.split("path", "/"), -1), "file_path": F.col("path"), "file_checksum": F.sha2("content", 256), "record_format": F.lit(recfm), "record_length": F.lit(record_length), "encoding": F.lit(encoding), "total_records": total, "created_at": F.current_timestamp()}
        f.select(*(given[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in TABLES["source_files"].split(", "))).write.mode("append").parquet(self.path("source_files"))

    def tell(self, run: str, event: str, table: str | None = None, loaded: int = 0, rejected: int = 0) -> None:
        """An event of a run's progress: table_progress or run_complete."""
        self.add("progress_events", run_id=run, table_name=table, event=event, rows_loaded=loaded, rows_rejected=rejected)

    def cancel_run(self, run: str) -> None:
        """A run that isn't finished takes no further table."""
        if self.status(run) in ("pending", "running"):
            self.change("migration_runs", run, status="cancelled", finished_at=now())

    def status(self, run: str) -> str | None:
        row = self.latest("migration_runs").where(F.col("id") == run).first()
        return row and row.status

    def start_run(self, project: str, kind: str = "full", config: str | None = None) -> str:
        top = self.latest("migration_runs").where(F.col("project_id") == project).agg(F.max("run_number")).first()[0]
        return self.add("migration_runs", project_id=project, run_number=(top or 0) + 1, run_type=kind, status="running", started_at=now(), config_snapshot=config, rows_extracted=0, rows_loaded=0, rows_rejected=0)

    def finish_run(self, run: str, status: str = "completed", error: str | None = None) -> None:
        t = self.latest("table_migration_states").where(F.col("run_id") == run).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("rows_extracted", "rows_loaded", "rows_rejected"))).first()
        self.change("migration_runs", run, status=status, finished_at=now(), error_message=error, rows_extracted=t[0], rows_loaded=t[1], rows_rejected=t[2])

    def start_table(self, run: str, table: str, checksum: str | None = None) -> str:
        return self.add("table_migration_states", run_id=run, table_name=table, status="running", source_checksum=checksum, started_at=now(), rows_extracted=0, rows_loaded=0, rows_rejected=0)

    def finish_table(self, state: str, extracted: int, loaded: int, rejected: int, status: str = "completed", error: str | None = None) -> None:
        self.change("table_migration_states", state, status=status, finished_at=now(), rows_extracted=extracted, rows_loaded=loaded, rows_rejected=rejected, error_message=error)

    def log_rejections(self, run: str, state: str, rows: DataFrame) -> None:
        """rows: line_num, raw, errors. Written by the executors, one row for each bad column."""
        e = rows.select("line_num", "raw", F.explode("errors").alias("e"))
        self._log(run, state, e, F.to_json(F.struct(F.col("e.column").alias("column"), F.col("e.raw_hex").alias("raw_hex"))), "decode", F.col("e.message"))

    def log_refusals(self, run: str, state: str, rows: DataFrame) -> None:
        """rows: line_num, raw, reject_reason and the decoded columns of what the loader refused."""
        values = [c for c in rows.columns if c not in ("line_num", "raw", "reject_reason")]
        self._log(run, state, rows, F.to_json(F.struct(*(F.col(f"`{c}`") for c in values))), "load", F.col("reject_reason"))

    def _log(self, run: str, state: str, rows: DataFrame, partial: Column, kind: str, message: Column) -> None:
        out = rows.select(
            F.expr("uuid()").alias("id"), F.lit(run).alias("run_id"), F.lit(state).alias("table_state_id"), F.col("line_num").alias("source_line_num"), F.col("raw").alias("raw_bytes"),
            partial.alias("decoded_partial"), F.lit(kind).alias("error_type"), message.alias("error_message"), F.current_timestamp().alias("created_at"),
        )
        out.write.mode("append").parquet(self.path("rejection_log"))

    def completed(self, project: str, table: str, checksum: str) -> bool:
        runs = self.latest("migration_runs").where(F.col("project_id") == project).select(F.col("id").alias("run_id"))
        done = self.latest("table_migration_states").where((F.col("table_name") == table) & (F.col("source_checksum") == checksum) & (F.col("status") == "completed"))
        return bool(done.join(runs, "run_id", "left_semi").head(1))
