"""Parquet tables of a directory, and the rule for rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table DIRECTORY/NAME.parquet, a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, keys: list[str | Column], value_columns: list[str], by: str = "ingested_at") -> DataFrame:
    """One row per key: the delivery with the latest `by`.

    An aggregate, not a window, so that a key delivered millions of times is reduced before the shuffle.
    A null `by` counts as older than any time. Among equal times the greatest values count, where they can be ordered,
    so the result doesn't depend on the order of rows. Null keys form a group like any other.
    """
    order = F.struct(F.col(by).isNotNull().alias("known"), F.col(by).alias("at"))
    grouped = df.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), F.struct(*value_columns).alias("r"))).alias("_m"))
    return grouped.select(*[grouped[c] for c in grouped.columns[:-1]], "_m.r.*")


def latest_value(df: DataFrame, keys: list[str | Column], value: str, by: str = "ingested_at") -> DataFrame:
    """`latest` for one column of a fixed-width type, by a time: a hash aggregate without sorting. Of equal times the result is one of them."""
    order = F.coalesce(F.col(by), F.lit("0001-01-01 00:00:00").cast(df.schema[by].dataType))  # in its own type, whatever the time zone
    return df.groupBy(*keys).agg(F.max_by(F.col(value), order).alias(value))
