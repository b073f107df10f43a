"""Validation: counts, rejection rates, aggregates, samples, orphans and rules, as DataFrames of named checks."""

from __future__ import annotations

import math
from collections.abc import Iterable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.01
#: Of samples: the confidence of a statement on all rows, and its margin.
CONFIDENCE, MARGIN = 0.995, 0.001


def count_check(states: DataFrame) -> DataFrame:
    """Whether what was extracted was loaded or rejected, with the reason."""
    fine = F.coalesce("rows_extracted", F.lit(0)) == F.coalesce("rows_loaded", F.lit(0)) + F.coalesce("rows_rejected", F.lit(0))
    return states.withColumn("passed", fine)


def rejection_rate() -> Column:
    return F.when(F.col("rows_extracted") > 0, F.col("rows_rejected") / F.col("rows_extracted")).otherwise(F.lit(0.0))


def rate_check(states: DataFrame, most: float = RATE) -> DataFrame:
    return states.withColumn("rate", rejection_rate()).withColumn("rate_text", F.format_string("%.2f%%", F.col("rate") * 100)).withColumn("passed", F.col("rate") < most)


def all_passed(checks: DataFrame, *by: str) -> DataFrame:
    """Whether all checks of a group passed; no checks: yes."""
    return checks.groupBy(*by).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def figures(rows: DataFrame, columns: Iterable[str], scale: int = 2) -> DataFrame:
    """column_name, n, total, least, most, n_distinct in long form. Each column is read alone and grouped by its values, whose
    counts give all figures; several distinct counts at once would multiply the rows instead."""
    d = F.col("v").cast(f"decimal(20,{scale})")
    parts = []
    for c in columns:
        values = rows.select(F.col(c).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        parts.append(
            values.agg(
                F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("n"), F.sum(d * F.col("k").cast("decimal(18,0)")).cast(f"decimal(38,{scale})").alias("total"),
                F.min(d).alias("least"), F.max(d).alias("most"), F.count("v").alias("n_distinct"),
            ).select(F.lit(c).alias("column_name"), "*")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def aggregates_check(source: DataFrame, target: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    names = ("n", "total", "least", "most", "n_distinct")
    a, b = figures(source, columns), figures(target, columns)
    t = b.select("column_name", *(F.col(x).alias(f"target_{x}") for x in names))
    same = F.lit(True)
    for x in names:
        same = same & F.col(x).eqNullSafe(F.col(f"target_{x}"))
    return a.join(t, "column_name", "left").withColumn("passed", same)


def sample_check(source: DataFrame, target: DataFrame, key: str, every: int = 97) -> DataFrame:
    """Rows of the keys that every divides, compared column by column: how many there are, how many differ or are missing."""
    columns = [c for c in source.columns if c != key]
    pick = F.col(key) % every == 0
    a = source.where(pick).select(key, F.struct(*columns).alias("a"))
    b = target.where(pick).select(key, F.struct(*columns).alias("b"))
    return a.join(b, key, "full_outer").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))


def sample_size(total: int, confidence: float = CONFIDENCE, margin: float = MARGIN, share: float = 0.5) -> int:
    """Rows of `total` to compare so that a share of errors is known within +-margin at the confidence; the share expected, a half
    at worst."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    n = z * z * share * (1 - share) / margin**2
    return min(total, math.ceil(n / (1 + (n - 1) / total))) if total else 0


def interval(k: Column, n: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """Wilson's interval of the share k of n."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    p = k / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / (1 + z * z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def confidence_check(source: DataFrame, target: DataFrame, keys: list[str], confidence: float = CONFIDENCE, margin: float = MARGIN, share: float = 0.5, most: float | None = None) -> DataFrame:
    """One row: n_keys of the source, n_sampled, n_different (rows that differ in some column, or are on one side only), rate,
    low and high (the interval of the share of errors at the confidence), passed: whether all of it is at most `most` (the margin, where
    it isn't given).

    Both sides are sampled by the same threshold on a hash of the key, so a key is in both samples or in neither, no matter
    how often a job runs, and only the samples are shuffled. Rows of repeated keys are compared as sorted lists."""
    total = source.count()
    bound = round(2**32 * sample_size(total, confidence, margin, share) / total) if total else 2**32
    columns = [c for c in source.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select(*(F.col(k).cast(source.schema[k].dataType).alias(k) for k in keys), *(F.col(c).cast(source.schema[c].dataType).alias(c) for c in columns))
        picked = own.where(F.pmod(F.xxhash64(*keys), F.lit(2**32)) < bound)
        return picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*(columns or keys)))).alias(name))

    a, b = side(source, "a"), side(target, "b").withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = a.join(b, on, "full_outer").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"))
    low, high = interval(F.col("n_different"), F.col("n_sampled"), confidence)
    some = lambda c, none: F.when(F.col("n_sampled") > 0, c).otherwise(F.lit(none))
    out = met.select(F.lit(total).cast("long").alias("n_keys"), "n_sampled", "n_different", some(F.col("n_different") / F.col("n_sampled"), 0.0).alias("rate"), some(low, 0.0).alias("low"), some(high, 0.0 if total == 0 else 1.0).alias("high"))
    return out.withColumn("passed", F.col("high") <= (margin if most is None else most))


def extraction_counts(rows: DataFrame, raw: str = "__raw") -> DataFrame:
    """n_ok, n_errors and n_bytes of decoded rows that kept their record."""
    return rows.agg(F.count_if(F.size("errors") == 0).alias("n_ok"), F.count_if(F.size("errors") > 0).alias("n_errors"), F.coalesce(F.sum(F.length(raw)), F.lit(0)).cast("long").alias("n_bytes"))


def null_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in rows.columns)).alias("x")).select(F.inline("x"))


def orphans(children: DataFrame, parents: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    keys = parents.select(*(F.col(p).alias(c) for c, p in on)).distinct()
    return children.join(keys, [c for c, _ in on], "left_anti")


def rule_counts(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule, a condition in SQL that should hold nowhere."""
    return rows.agg(F.array(*(F.struct(F.lit(k).alias("rule"), F.count_if(F.expr(x)).alias("n_broken")) for k, x in rules.items())).alias("x")).select(F.inline("x")).withColumn("passed", F.col("n_broken") == 0)
