"""Sources whose columns a compiled table describes: delimited text, and unloads of a database in V records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.operators.decode import DecodeOptions, decode
from copperleaf.plans.schema import Table
from copperleaf.sources import records


def delimited(spark: SparkSession, path: str, t: Table, separator: str = ",", header: bool = False, **options: str) -> DataFrame:
    """The table's columns, typed, and errors: one entry for a line that doesn't fit them."""
    columns = [c for c in t.columns if c.kind not in ("row_number", "array", "overlay")]
    schema = ", ".join(f"`{c.name}` {'date' if c.date_format else c.type.spark}" for c in columns)
    rows = spark.read.options(**options).csv(path, f"{schema}, `__line` string", separator, header=header, columnNameOfCorruptRecord="__line", mode="PERMISSIVE")
    error = F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("int").alias("byte_offset"), F.lit(None).cast("int").alias("byte_length"), F.lower(F.hex("__line")).alias("raw_hex"), F.lit("line does not fit the columns").alias("message"))
    return rows.withColumn("errors", F.when(F.col("__line").isNotNull(), F.array(error)).otherwise(F.array().cast("array<struct<column:string,byte_offset:int,byte_length:int,raw_hex:string,message:string>>"))).drop("__line")


def unloaded(content: DataFrame, t: Table, options: DecodeOptions = DecodeOptions(), on_error: str = "reject") -> DataFrame:
    """Rows that a database unloaded as records with descriptors, from rows path, content (see records.files)."""
    return decode(records.variable(content), t, options, on_error)
