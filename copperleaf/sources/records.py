"""Record files as DataFrames file, line_num, raw.

Files of all formats are split between tasks, whatever their size (ranges.py). The functions of rows (path, length, content)
are for records that come as rows, a file each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.sources import ranges

#: Records of a fixed file that are cut from it at once; each such piece is a row of its own between the two cuts.
AT_ONCE = 8192


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def fixed(content: DataFrame, record_length: int, skip: int = 0) -> DataFrame:
    """Records of one length. A short tail is left out; skipped headers are counted in line_num."""
    if record_length < 1:
        raise ValueError("fixed-length records need a record length")
    step = record_length * AT_ONCE
    size = F.expr(f"length(content) div {record_length}")
    pieces = content.where(size > 0).select(
        F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), F.expr(f"(length(content) div {record_length} - 1) div {AT_ONCE}"))).alias("piece")
    ).select("file", "piece", F.expr(f"substring(content, cast(piece * {step} + 1 as int), {step})").alias("part"))
    rows = pieces.select("file", "piece", "part", F.explode(F.sequence(F.lit(0), F.expr(f"length(part) div {record_length} - 1"))).alias("k"))
    out = rows.select("file", F.expr(f"cast(piece * {AT_ONCE} + k + 1 as bigint)").alias("line_num"), F.expr(f"substring(part, cast(k * {record_length} + 1 as int), {record_length})").alias("raw"))
    return out.where(F.col("line_num") > skip) if skip else out


def split_fixed(spark: SparkSession, path: str, record_length: int, skip: int = 0) -> DataFrame:
    """Records of one length from files of any size, read by the JVM's fixed-length input format. A file's records are
    numbered by where their split begins, so nothing is counted first. Files must hold whole records."""
    if record_length < 1:
        raise ValueError("fixed-length records need a record length")
    rdd = spark._jsc.sc().binaryRecords(path, record_length, spark._jsc.hadoopConfiguration())
    rows = DataFrame(spark._jsparkSession.createDataset(rdd, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark).toDF("raw")
    at = F.expr(f"input_file_block_start() div {record_length} + (monotonically_increasing_id() & {(1 << 33) - 1}) + 1")
    out = rows.select(F.input_file_name().alias("file"), at.cast("long").alias("line_num"), "raw")
    return out.where(F.col("line_num") > skip) if skip else out


def fixed_files(spark: SparkSession, path: str, record_length: int, skip: int = 0) -> DataFrame:
    """Records of one length of all files at a path. Those with a short tail are read by ranges, the others in the JVM."""
    if record_length < 1:
        raise ValueError("fixed-length records need a record length")
    sizes = ranges.sizes(spark, path)
    cut = [r.file for r in sizes.where(F.col("length") % record_length != 0).select("file").collect()]  # names of files
    if not cut:
        return split_fixed(spark, path, record_length, skip)
    whole = [r.file for r in sizes.where((F.col("length") % record_length == 0) & (F.col("length") > 0)).select("file").collect()]
    out = ranges.fixed(spark, cut, record_length)
    out = out.where(F.col("line_num") > skip) if skip else out
    return out.unionAll(split_fixed(spark, ",".join(whole), record_length, skip)) if whole else out


def fixed_count(content: DataFrame, record_length: int) -> DataFrame:
    return content.agg(F.coalesce(F.sum(F.expr(f"length div {record_length}")), F.lit(0)).cast("long").alias("n"))


def variable(content: DataFrame, in_blocks: bool = False) -> DataFrame:
    """Records of files with record descriptors, numbered from 1 in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                rows: list[bytes] = []
                begin = size = 0
                own = data.as_py() or b""
                for a, e in ranges.spans(own, 0, len(own), len(own), in_blocks):
                    if a < 0:
                        continue
                    rows.append(own[a:e])
                    size += e - a
                    if size > 4 << 20:
                        yield ranges.made(path.as_py(), begin, rows)
                        begin, rows, size = begin + len(rows), [], 0
                if rows:
                    yield ranges.made(path.as_py(), begin, rows)

    return content.select("path", "content").mapInArrow(run, ranges.RECORD)


def lines(content: DataFrame) -> DataFrame:
    """Line-delimited records, without the line ends; an empty last line is none."""
    hexes = F.split(F.regexp_replace(F.regexp_replace(F.hex("content"), "(..)", "$1,"), "0D,0A,", "0A,"), "0A,")
    parts = content.select(F.col("path").alias("file"), F.posexplode(hexes).alias("k", "x"), F.size(hexes).alias("n"))
    return parts.where("x <> '' or k < n - 1").select("file", (F.col("k") + 1).cast("long").alias("line_num"), F.unhex(F.replace("x", F.lit(","), F.lit(""))).alias("raw"))


def read_records(spark: SparkSession, path: str, recfm: str, record_length: int | None = None, skip: int = 0) -> DataFrame:
    """F, V, VB or D files at a path."""
    match recfm.upper():
        case "F" | "FB":
            if not record_length:
                raise ValueError("recfm F needs record_length")
            return fixed_files(spark, path, record_length, skip)
        case "V":
            return ranges.variable(spark, path)
        case "VB":
            return ranges.variable(spark, path, in_blocks=True)
        case "D":
            return ranges.lines(spark, path)
    raise ValueError(f"unknown record format {recfm}")


def checksums(content: DataFrame) -> DataFrame:
    return content.select("path", F.sha2("content", 256).alias("checksum"))


def source_checksum(spark: SparkSession, path: str, recfm: str, record_length: int | None = None) -> str:
    """One checksum of all files at a path, their names aside, so that no task has to read a whole file: of the sums of the
    SHA-256 of fixed records, or of ranges of bytes, each with its number."""
    if recfm.upper() in ("F", "FB") and record_length:
        rows = fixed_files(spark, path, record_length).select(F.col("line_num").alias("number"), "raw")
    else:
        rows = ranges.digests(spark, path)
    h = F.sha2(F.concat(F.encode(F.col("number").cast("string"), "UTF-8"), F.col("raw")), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.select(h.alias("h")).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *map(part, range(4))), 256)).first()[0]


# --- the other way ------------------------------------------------------------------------------------------------


def described(raw: str = "raw") -> str:
    """SQL of a record with its descriptor."""
    return f"concat(unhex(lpad(hex(length({raw}) + 4), 4, '0')), X'0000', {raw})"


def as_files(records: DataFrame, order: str, per_file: int, framing: str = "raw", block: int = 0) -> DataFrame:
    """path, length, content: records (raw) put into files of the keys order div per_file, in that order; a stand-in for
    files on disk that stays distributed. block: records of a block, with block descriptors."""
    one = records.select(F.expr(f"{order} div {per_file}").alias("k"), F.col(order).alias("o"), F.hex(F.expr(framing)).alias("h"))
    if block:
        blocks = one.groupBy("k", F.expr(f"o % {per_file} div {block}").alias("o")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "").alias("h"))
        one = blocks.withColumn("h", F.expr("concat(lpad(hex(length(h) div 2 + 4), 4, '0'), '0000', h)"))
    body = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""))
    out = one.groupBy("k").agg(body.alias("content"))
    return out.select(F.concat(F.lit("part-"), F.col("k").cast("string")).alias("path"), F.length("content").cast("long").alias("length"), "content")
