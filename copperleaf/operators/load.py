"""Loading rows: truncate, append or upsert, with bad rows set apart before anything is written.

What a database rejects row by row is worked out as sets: rows that miss a key or fail a check, and, on append, later
rows of a key. So a failing batch needs no bisection, and the rows that land are those that can be inserted alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

MODES = ("truncate_load", "append", "upsert")


@dataclass(frozen=True)
class Check:
    name: str
    column: str
    values: tuple

    def holds(self) -> Column:
        """As in SQL, a null passes."""
        return F.coalesce(F.col(self.column).isin(*self.values), F.lit(True))


#: A column of reasons that rows may bring along: those that have one are refused for it.
REFUSED = "__refused"


def judged(rows: DataFrame, pk: list[str] | None = None, checks: tuple[Check, ...] = (), order: list[str] | None = None) -> DataFrame:
    """rows with reject_reason, null for those that can land. With an order, later rows of a key are duplicates."""
    reason = F.lit(None).cast("string")
    for c in reversed(checks):
        reason = F.when(~c.holds(), F.lit(f"check {c.name}")).otherwise(reason)
    for k in reversed(pk or []):
        reason = F.when(F.col(k).isNull(), F.lit(f"null in {k}")).otherwise(reason)
    if REFUSED in rows.columns:
        reason = F.coalesce(F.col(REFUSED), reason)
    out = rows.withColumn("reject_reason", reason).drop(REFUSED)
    return without_repeats(out, pk, order) if pk and order else out


DUPLICATE = "duplicate key"


def without_repeats(rows: DataFrame, pk: list[str], order: list[str]) -> DataFrame:
    """Judged rows; of those that could land, the later ones of a key can't."""
    n = F.row_number().over(Window.partitionBy(*pk, F.col("reject_reason").isNull()).orderBy(*order))
    return rows.withColumn("__n", n).withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & (F.col("__n") > 1), F.lit(DUPLICATE)).otherwise(F.col("reject_reason"))).drop("__n")


def with_repeats_found(rows: DataFrame, pk: list[str], order: list[str], path: str) -> DataFrame:
    """without_repeats() where most keys occur once: the keys that occur more often are found and written first, so that only
    keys are shuffled, and of whole rows those with such a key."""
    own = rows.where("reject_reason is null").groupBy(*pk).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*pk)
    own.write.mode("overwrite").parquet(path)
    repeated = rows.sparkSession.read.schema(own.schema).parquet(path)
    if repeated.isEmpty():
        return rows
    can_land = F.col("reject_reason").isNull()
    alone = rows.where(can_land).join(repeated, pk, "left_anti").select(*rows.columns)
    several = rows.where(can_land).join(repeated, pk, "left_semi").select(*rows.columns)
    return rows.where(~can_land).unionAll(alone).unionAll(without_repeats(several, pk, order))


def landed(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def refused(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is not null")


def last_of_key(rows: DataFrame, pk: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by the order; ties leave one of equal rows."""
    n = F.row_number().over(Window.partitionBy(*pk).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def upserted(target: DataFrame, source: DataFrame, pk: list[str] | None, order: list[str] | None = None) -> DataFrame:
    """The target after the source's rows replaced or joined it; of equal keys in the source the last wins."""
    if not pk:
        raise ValueError("upsert needs the primary key's columns")
    new = last_of_key(source, pk, order) if order else source.dropDuplicates(pk)
    return target.join(new.select(*pk), pk, "left_anti").unionByName(new.select(*target.columns))


def load(rows: DataFrame, path: str, mode: str = "truncate_load", pk: list[str] | None = None, checks: tuple[Check, ...] = (), order: list[str] | None = None, rejects: str | None = None, keep: list[str] | None = None) -> dict:
    """Writes Parquet; returns rows loaded and rejected, counted while they are written. keep: the columns to write, all
    where it isn't given. Rows with a REFUSED reason are rejected for it. Except for append, the new table is written beside the old one and then takes its place, so
    whatever fails, one of them is there whole."""
    if mode not in MODES:
        raise ValueError(f"unknown load mode {mode}")
    if mode == "upsert" and not pk:
        raise ValueError("upsert needs the primary key's columns")
    spark, seen = rows.sparkSession, Observation()
    out, repeats = judged(rows, pk, checks), f"{path.rstrip('/')}__repeated"
    if pk and order and mode != "upsert":
        out = with_repeats_found(out, pk, order, repeats)
    counted = out.observe(seen, F.count_if(F.expr("reject_reason is null")).alias("loaded"), F.count_if(F.expr("reject_reason is not null")).alias("rejected"))
    good, columns = landed(counted), keep or [c for c in rows.columns if c != REFUSED]
    recover(spark, path)
    if mode == "append":
        good.select(*columns).write.mode("append").parquet(path)
    else:
        if mode == "upsert":
            new = last_of_key(good, pk, order) if order else good
            good = upserted(spark.read.parquet(path), new.select(*columns), pk) if _exists(spark, path) else new if order else good.dropDuplicates(pk)
        staged = f"{path.rstrip('/')}__staged"
        good.select(*columns).write.mode("overwrite").parquet(staged)
        _take_place(spark, path, staged)
    if rejects:
        refused(out).write.mode("append").parquet(rejects)
    remove(spark, repeats)
    return dict(seen.get)


def _place(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, path: str) -> bool:
    p, fs = _place(spark, path)
    return fs.exists(p)


def _take_place(spark, path: str, staged: str) -> None:
    """staged becomes path; the table that was there is aside until then, where recover() finds it."""
    (p, fs), (old, _), (new, _) = (_place(spark, x) for x in (path, f"{path.rstrip('/')}__old", staged))
    if fs.exists(p):
        fs.delete(old, True)
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


def remove(spark, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def recover(spark, path: str) -> None:
    """Puts back the table that a load which broke off between its two renames has left aside."""
    (p, fs), (old, _) = (_place(spark, x) for x in (path, f"{path.rstrip('/')}__old"))
    if not fs.exists(p) and fs.exists(old):
        fs.rename(old, p)
