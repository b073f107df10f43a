"""Files and changes that arrive over time, read by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.operators.load import last_of_key


def new_files(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame], None], seen: str) -> None:
    """Reads what has arrived since the last call: each(rows of path, length, content) for files whose content is new.

    Checksums of loaded files are kept in the table seen, so a file that comes again under another name is skipped."""

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.withColumn("checksum", F.sha2("content", 256))
        p = spark._jvm.org.apache.hadoop.fs.Path(seen)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            own = own.join(spark.read.schema("checksum string, batch long").parquet(seen).where(F.col("batch") != number), "checksum", "left_anti")
        own = own.dropDuplicates(["checksum"])
        each(own.select("path", "length", "content"))
        own.select("checksum", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(seen)

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_changes(spark: SparkSession, changes: DataFrame, target: str, key: str, order: list[str], checkpoint: str) -> None:
    """A change stream into a table with the latest row of each key. Every batch writes a new version beside the old
    one, so a batch that is repeated gives the same table: read it with current()."""

    def batch(rows: DataFrame, number: int) -> None:
        old = _version(spark, target, number)
        merged = rows if old is None else old.unionByName(rows)
        last_of_key(merged, [key], order).write.mode("overwrite").parquet(f"{target}/version={number}")

    changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, target: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()[8:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("version=")) if fs.exists(p) else []


def _version(spark: SparkSession, target: str, below: int) -> DataFrame | None:
    n = [v for v in _versions(spark, target) if v < below]
    return spark.read.parquet(f"{target}/version={n[-1]}") if n else None


def current(spark: SparkSession, target: str) -> DataFrame | None:
    return _version(spark, target, 1 << 62)
