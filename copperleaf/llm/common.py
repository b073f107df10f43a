"""What the operators share: reading tables, cutting lineage, bounded batches of rows."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bits of a bitmap for each key that it holds, and of one bitmap at most (16 MB). More keys get no bitmap: every row goes
#: on to the join that follows.
PER_KEY, MOST_BITS = 8, 1 << 27
#: Bytes of text that a block of rows holds at most, one longer row excepted.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, a local session gets one of its own;
    on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Inside, the session's setting is this one; afterwards it is what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe when executors are lost. The shuffle files
    behind it go, nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/copperleaf-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes the files of cut() tables that nothing will read again."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: str = "8m"):
    """Inside, rows go to Python in batches of fewer bytes: for actions on rows that are large."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def smallest(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """`rows` rows of df at most: those of the smallest hash of `by`, all columns that are used later, so that rows of equal
    hash are equal and it doesn't matter which are taken. Only hashes are sorted; the rows stay where they are."""
    h = F.xxhash64(*by)
    last = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)).limit(rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text column of each piece holds about `limit` bytes at most. After the last one, what
    Arrow holds unused goes back: a worker serves many tasks."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if batch.num_rows <= 1 or column.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        begin = size = 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if i > begin and size + (n or 0) > limit:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


class Marks:
    """Which of any 64-bit hashes may be among those of a table (one column, written by cut()): a bitmap on the executors
    with PER_KEY bits for each row, compressed. It keeps rows away from a join and decides nothing alone: keys that share a
    bit pass, and where it would have more than MOST_BITS all keys pass."""

    def __init__(self, keys: DataFrame, most: int | None = None):
        self.bits = 1 << max(16, (PER_KEY * keys.count() - 1).bit_length())
        self.sent, self.name = None, uuid.uuid4().hex
        if self.bits <= (MOST_BITS if most is None else most):
            bit = F.col(keys.columns[0]).bitwiseAND(F.lit(self.bits - 1))
            words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("x")).toArrow()
            out = np.zeros(self.bits // 64, np.int64)
            out[words["w"].to_numpy()] = words["x"].to_numpy()
            self.sent = keys.sparkSession.sparkContext.broadcast(zlib.compress(out.tobytes(), 1))

    @property
    def value(self) -> np.ndarray:
        if self.name not in _opened:
            while len(_opened) > 3:
                _opened.pop(next(iter(_opened)))
            _opened[self.name] = np.frombuffer(zlib.decompress(self.sent.value), np.uint64)
        return _opened[self.name]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """For each of 64-bit keys, whether the table may have it."""
        if self.sent is None:
            return np.ones(len(keys), bool)
        bit = keys.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


#: Bitmaps that this worker has opened.
_opened: dict[str, np.ndarray] = {}


def tallied(keys: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """key, n: how often each key occurs in each array. Summed there before Spark sums it up, so a hot key is one row each."""
    for x in keys:
        values, n = np.unique(x, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["key", "n"])


def repeated(tallies: DataFrame, least: int = 2) -> DataFrame:
    """key, n of the keys that occur `least` times or more in the rows of tallied()."""
    return cut(tallies.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def parted(docs: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose text's hash is in no row of hashes (one column) for certain, and the others with their hash as __h.

    So only rows that may be concerned go on to a join."""
    wanted = Marks(hashes)
    at, schema = docs.columns.index("text"), docs.schema

    def split(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(text_hash, b.column(at).to_pylist()), np.int64, b.num_rows)
        return h, wanted.of(h)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield b.filter(pa.array(~split(b)[1]))

    def concerned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            h, m = split(b)
            yield pa.RecordBatch.from_arrays([*b.filter(pa.array(m)).columns, pa.array(h[m])], [*b.schema.names, "__h"])

    return docs.mapInArrow(others, schema), docs.mapInArrow(concerned, StructType([*schema, StructField("__h", LongType())]))
