"""The daily metric tables: normal keys, counting rows, grids and rolling totals over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions.urls import domain_key, page_key
from skarv.operators.grid import readings, regular_grid
from skarv.operators.rolling import RollingState
from skarv.runtime import cut, table_path
from skarv.sources.tables import latest_value, table

#: The reading of each table and its range.
READINGS = {"gsc_page_daily": ("position", 1.0, None), "ga4_landing_page_daily": ("bounce_rate", 0.0, 1.0)}
COUNTS = {"gsc_page_daily": ["clicks", "impressions"], "ga4_landing_page_daily": ["sessions"]}


def normal_keys(df: DataFrame) -> DataFrame:
    """domain and page in their normal forms."""
    return df.withColumns({"domain": domain_key(F.col("domain")), "page": page_key(F.col("page"))})


def page_grid(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """domain, page, date, value, state of one metric table (see `regular_grid`)."""
    value, low, high = READINGS[name]
    rows = normal_keys(table(spark, directory, name).select("domain", "date", "page", value, "ingested_at").filter(F.col("date").isNotNull()))
    counting = latest_value(rows, ["domain", "page", "date"], value)
    return regular_grid(readings(counting, ["domain", "page"], "date", value, low, high), ["domain", "page"], low, high)


def page_rolling(spark: SparkSession, directory: str) -> DataFrame:
    """series_table, domain, page, date and rolling totals over 7 and 30 days of all metric tables' counts, in one state.

    The first delivery of every day makes the state; days that were delivered again with other counts are corrections to it. Counts
    that a table doesn't have are null.
    """
    keys, metrics = ["series_table", "domain", "page"], [m for names in COUNTS.values() for m in names]

    def rows(name: str) -> DataFrame:
        own = normal_keys(table(spark, directory, name).select("domain", "date", "page", *COUNTS[name], "ingested_at").filter(F.col("date").isNotNull()))
        counts = [F.col(m) if m in COUNTS[name] else F.lit(None).cast("bigint").alias(m) for m in metrics]
        return own.select(F.lit(name).alias("series_table"), "domain", "page", "date", "ingested_at", *counts)

    order = F.struct(F.col("ingested_at").isNotNull(), F.col("ingested_at"), *metrics)
    values = F.struct(*metrics)
    delivered = reduce(DataFrame.unionByName, map(rows, COUNTS)).groupBy(*keys, "date").agg(F.min_by(values, order).alias("first"), F.max_by(values, order).alias("last"))
    delivered = cut(delivered, "daily-deliveries")
    state = RollingState(spark, table_path(spark, "rolling-state"), keys, metrics)
    state.advance(delivered.select(*keys, "date", "first.*"))
    state.correct(delivered.filter(~F.col("first").eqNullSafe(F.col("last"))).select(*keys, "date", "last.*"))
    own = {m: name for name, names in COUNTS.items() for m in names}
    totals = state.totals()
    return totals.select(*[F.when(F.col("series_table") == own[c.rsplit("_", 2)[0]], F.col(c)).alias(c) if c.rsplit("_", 2)[0] in own else F.col(c) for c in totals.columns])
