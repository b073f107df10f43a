"""Change data with operations: inserts, updates and deletes into a table, after a baseline and up to a cutover.

A table is its base (rows in buckets of keys) and the deltas that came since, one for each batch: the last change of each
key in it. So a batch costs what it holds. merge() rewrites the buckets that deltas touch and no others; a manifest
names, for each bucket, the version of the base that holds it, and is written last, so a merge that breaks off changes
nothing.

Positions (log sequence numbers) order the changes of a key, whatever the order of their batches; at equal positions a
delete wins. Deleted keys stay as tombstones, so a late, older change brings nothing back; changes up to the baseline's
position are in the baseline already and are passed over. A batch that is repeated writes the same delta again.

Changes without a key or position, or with an operation other than I, U and D, are set aside in refused(). A table is
in one of the STATES; after the cutover it takes no more changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.operators.load import _exists, _place, last_of_key, remove

STATES = ("new", "baseline", "catching_up", "cut_over")
OPERATIONS = ("I", "U", "D")


class ChangeTable:
    """At a folder that all executors share. buckets: into how many a new table's keys are dealt, as many as keep one small."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], position: str, op: str = "op", buckets: int = 64):
        self.spark, self.folder, self.keys, self.position, self.op = spark, folder.rstrip("/"), keys, position, op
        layout = self._last("layout", buckets=buckets, columns=None)
        self.buckets, self.columns = int(layout["buckets"]), layout["columns"]  # columns: of base and deltas, as SQL

    # --- small tables: the last row of each is what holds

    def _last(self, name: str, **default):
        path = f"{self.folder}/{name}"
        if not _exists(self.spark, path):
            return default
        return self.spark.read.parquet(path).orderBy(F.desc("n")).first().asDict()

    def _note(self, name: str, **values) -> None:
        n = self._last(name, n=0)["n"] + 1
        self.spark.createDataFrame([(n, *values.values())], ["n", *values]).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def state(self) -> str:
        return self._last("states", state="new")["state"]

    def _numbers(self, part: str, key: str) -> list[int]:
        """Those of the finished writes below a part of the folder."""
        path = f"{self.folder}/{part}"
        if not _exists(self.spark, path):
            return []
        p, fs = _place(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(x[len(key) + 1 :]) for x in names if x.startswith(f"{key}=") and _exists(self.spark, f"{path}/{x}/_SUCCESS"))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    # --- baseline, changes, cutover

    def baseline(self, rows: DataFrame, at) -> None:
        """The table as it was at a position: no operations."""
        if self.state() != "new":
            raise ValueError("the table has a baseline already")
        full = rows.withColumn(self.position, F.lit(at).cast("long" if isinstance(at, int) else "string")).withColumn("deleted", F.lit(False))
        self.columns = ", ".join(f"`{name}` {kind}" for name, kind in full.dtypes)
        self._note("layout", buckets=self.buckets, columns=self.columns)
        self._write_base(self._bucketed(full), 0, -1)
        self._note("states", state="baseline", position=str(at))

    def _write_base(self, rows: DataFrame, version: int, through: int) -> None:
        path = f"{self.folder}/base/version={version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        p, fs = _place(self.spark, path)
        found = [int(x[7:]) for x in (f.getPath().getName() for f in fs.listStatus(p)) if x.startswith("bucket=")]
        own = self.spark.createDataFrame([(b, version) for b in found], "bucket int, version int")
        before = self._manifest()
        kept = before[0].join(own, "bucket", "left_anti") if before else None
        every = own if kept is None else kept.unionByName(own)
        every.withColumn("through", F.lit(through).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def _manifest(self) -> tuple[DataFrame, int, int] | None:
        """bucket and version of each part of the base, the last batch in it, the manifest's own version."""
        versions = self._numbers("manifest", "version")
        if not versions:
            return None
        rows = self.spark.read.schema("bucket int, version int, through long").parquet(f"{self.folder}/manifest/version={versions[-1]}")
        through = rows.agg(F.max("through")).first()[0]
        return rows.select("bucket", "version"), -1 if through is None else through, versions[-1]

    def apply(self, changes: DataFrame, number: int) -> None:
        """A batch of changes: rows with keys, position, operation and the other columns (nulls for deletes)."""
        if self.state() not in ("baseline", "catching_up"):
            raise ValueError(f"no changes can be applied, the table is {self.state()}")
        start = self.spark.read.parquet(f"{self.folder}/states").where("state = 'baseline'").first()["position"]
        whole = F.col(self.op).isin(*OPERATIONS) & F.col(self.position).isNotNull()
        for k in self.keys:
            whole = whole & F.col(k).isNotNull()
        whole = F.coalesce(whole, F.lit(False))
        changes.where(~whole).write.mode("overwrite").parquet(f"{self.folder}/refused/batch={number}")
        later = F.col(self.position) > F.lit(start).cast(changes.schema[self.position].dataType)
        good = changes.where(whole).where(later).withColumn("deleted", F.col(self.op) == "D").drop(self.op)
        good = good.withColumn(self.position, F.col(self.position).cast("long" if " bigint" in self._kind() else "string"))
        last = last_of_key(good, self.keys, [self.position, "deleted"])
        self._bucketed(last).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/deltas/batch={number}")
        if self.state() == "baseline":
            self._note("states", state="catching_up", position=str(start))

    def _kind(self) -> str:
        return next(x for x in self.columns.split(", ") if x.startswith(f"`{self.position}`"))

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Applies what a change stream has."""
        changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def applied(self):
        """The last position in the table."""
        return self._rows().agg(F.max(self.position)).first()[0]

    def cut_over(self, end) -> None:
        """Ends the catching up, if the table has all changes up to the source's end."""
        if (now := self.applied()) is None or now < end:
            raise ValueError(f"the table has changes up to {now}, the source up to {end}")
        self.merge()
        self._note("states", state="cut_over", position=str(now))

    # --- reading and merging

    def _rows(self, touched: list[int] | None = None, batches: list[int] | None = None) -> DataFrame:
        """Base and deltas, of some buckets only if these are given."""
        own, through, _ = self._manifest()
        batches = [n for n in self._numbers("deltas", "batch") if n > through] if batches is None else batches
        kept = [r for r in own.collect() if touched is None or r.bucket in touched]  # a row for each bucket
        schema = self.spark.createDataFrame([], self.columns).schema
        parts = []
        for v in sorted({r.version for r in kept}):
            path = f"{self.folder}/base/version={v}"
            parts.append(self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/bucket={r.bucket}" for r in kept if r.version == v]))
        for n in batches:
            delta = self.spark.read.schema(f"{self.columns}, bucket int").parquet(f"{self.folder}/deltas/batch={n}")
            parts.append((delta if touched is None else delta.where(F.col("bucket").isin(touched))).drop("bucket"))
        names = schema.names
        parts = [p.select(*names) for p in parts] or [self.spark.createDataFrame([], schema).select(*names)]
        return reduce(DataFrame.unionByName, parts)

    def merge(self) -> None:
        """Takes the deltas into the base: the buckets that they touch are written anew."""
        _, through, version = self._manifest()
        batches = [n for n in self._numbers("deltas", "batch") if n > through]
        if not batches:
            return
        touched = sorted(r.bucket for n in batches for r in self.spark.read.schema("bucket int").parquet(f"{self.folder}/deltas/batch={n}").select("bucket").distinct().collect())
        merged = last_of_key(self._rows(sorted(set(touched)), batches), self.keys, [self.position, "deleted"])
        self._write_base(self._bucketed(merged), version + 1, batches[-1])
        for n in batches:
            remove(self.spark, f"{self.folder}/deltas/batch={n}")

    def current(self) -> DataFrame:
        """The table as it is now."""
        return last_of_key(self._rows(), self.keys, [self.position, "deleted"]).where("not deleted").drop("deleted", self.position)

    def refused(self) -> DataFrame | None:
        numbers = self._numbers("refused", "batch")
        return self.spark.read.parquet(*[f"{self.folder}/refused/batch={n}" for n in numbers]) if numbers else None
