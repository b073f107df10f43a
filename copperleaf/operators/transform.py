"""Rules between decoding and loading, each one change of a DataFrame's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.functions import codecs


def rename(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumnRenamed(column, to)


def type_cast(df: DataFrame, column: str, to: str, date_format: str | None = None) -> DataFrame:
    """What can't be cast becomes null."""
    return df.withColumn(column, codecs.date_of(F.col(column), date_format) if date_format else F.col(column).try_cast(to))


def lookup(df: DataFrame, column: str, values: dict[str, str], to: str | None = None, default: str | None = None) -> DataFrame:
    found = F.lit(default).cast("string")
    for k, v in values.items():
        found = F.when(F.col(column) == k, F.lit(v)).otherwise(found)
    return df.withColumn(to or column, found)


def lookup_table(df: DataFrame, column: str, table: DataFrame, key: str, value: str, to: str) -> DataFrame:
    """By a table of codes; Spark broadcasts it if its size is known to be small."""
    return df.join(table.select(F.col(key).alias(column), F.col(value).alias(to)).dropDuplicates([column]), column, "left")


def computed(df: DataFrame, to: str, expression: str) -> DataFrame:
    return df.withColumn(to, F.expr(expression))


def split(df: DataFrame, column: str, separator: str, to: list[str]) -> DataFrame:
    return df.withColumns({name: F.get(F.split(column, f"\\Q{separator}\\E"), F.lit(k)) for k, name in enumerate(to)})


def merge(df: DataFrame, columns: list[str], separator: str, to: str) -> DataFrame:
    """Nulls are left out."""
    return df.withColumn(to, F.concat_ws(separator, *columns))


def regex_replace(df: DataFrame, column: str, pattern: str, by: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, pattern, by))


def sentinel_null(df: DataFrame, column: str, sentinels: list[str]) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(codecs.is_sentinel(F.col(column), sentinels), F.lit(False)), F.col(column)))


def constant(df: DataFrame, to: str, value: object) -> DataFrame:
    return df.withColumn(to, F.lit(value))


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def transformed(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules in order, each {"rule": name, ...arguments}."""
    known = {f.__name__: f for f in (rename, type_cast, lookup, lookup_table, computed, split, merge, regex_replace, sentinel_null, constant, drop)}
    for r in rules:
        own = dict(r)
        name = own.pop("rule")
        if name not in known:
            raise ValueError(f"unknown rule {name}")
        df = drop(df, *own["columns"]) if name == "drop" else known[name](df, **own)
    return df
