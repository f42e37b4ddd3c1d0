"""Small tables of records – jobs, connections, integrations – and the listings made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order`, with all columns. An aggregate, so a hot key is reduced in each task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group by `order`, with rank_no from 1."""
    return df.withColumn("rank_no", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank_no") <= n)


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """domain, type, completed_at: the last completed job of each type for each domain."""
    done = jobs.filter((F.col("status") == "completed") & F.col("completed_at").isNotNull())
    return done.groupBy("domain", "type").agg(F.max("completed_at").alias("completed_at"))


def jobs_to_start(queued: DataFrame, running: DataFrame, key: str = "id") -> DataFrame:
    """Queued jobs that nobody is working on, as after a restart."""
    return queued.join(running.select(key), key, "left_anti")


def jobs_of(integrations: DataFrame, types: list[str]) -> DataFrame:
    """One row for each integration and job type. types are few and named by the caller; no table is multiplied."""
    return integrations.withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))


def updated_if(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that meet the condition with new values, the others as they were (a null condition is none)."""
    met = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def without_ids(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """df without the rows of some ids; rows without id stay."""
    return df.filter(F.col(key).isNull() | ~F.col(key).isin(ids))


def singleton(df: DataFrame, order: str = "id") -> DataFrame:
    """The one row that the table of a single record has; of several the last by `order`."""
    return df.orderBy(F.desc_nulls_last(order)).limit(1)


def replaced(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The table of a single record after a new one: the new one if there is any, else what was there."""
    fresh = singleton(new, new.columns[0]).select(*existing.columns)
    return fresh.unionByName(existing.join(fresh.select(F.lit(1).alias("_1")).limit(1), F.lit(True), "left_anti"))


def in_order(df: DataFrame, by: str = "domain") -> DataFrame:
    """Rows in the order of a column."""
    return df.orderBy(by)


def looked_up(df: DataFrame, integrations: DataFrame, domain: str = "domain") -> DataFrame:
    """df with the columns of its domain's integration, null where it has none; of several integrations the first by id."""
    one = unique_first(integrations, [domain], ["id"])
    return df.join(one, domain, "left")


def read_through(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): what is asked for from the cache, what it lacks from `fetched`; and the cache with that put in.

    Fetched rows of keys that the cache has are not used. Keys that neither has give no row.
    """
    asked = wanted.select(*keys).distinct()
    missing = fetched.join(asked, keys, "left_semi").join(cache.select(*keys), keys, "left_anti").select(*cache.columns)
    return cache.join(asked, keys, "left_semi").unionByName(missing), cache.unionByName(missing)


def properties(accounts: DataFrame) -> DataFrame:
    """account, property_id, name of nested account summaries (account, properties: array of property, displayName)."""
    each = accounts.select("account", F.explode("properties").alias("p"))
    return each.select("account", F.regexp_replace("p.property", "^properties/", "").alias("property_id"), F.col("p.displayName").alias("name"))


def series(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """keys, at, name, value: one series per key and value column, without its nulls."""
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, at, F.inline(pairs)).filter(F.col("value").isNotNull())


def snapshot_of(found: DataFrame, order: list[Column], most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(headers, items) of a snapshot of opportunities: by domain how many are kept, and the first `most` of each domain, all open."""
    items = first_per_group(found, ["domain"], order, most).withColumn("status", F.lit("open"))
    return items.groupBy("domain").agg(F.count("*").alias("opportunity_count")), items


def listed(items: DataFrame, most: int = 200, **conditions: object) -> DataFrame:
    """Opportunities that meet all conditions given, most urgent first, then newest: critical, high, medium, low."""
    wanted = [F.col(c) == F.lit(v) for c, v in conditions.items() if v is not None]
    rows = items.filter(reduce(lambda a, b: a & b, wanted)) if wanted else items
    place = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return rows.orderBy(place, F.desc("created_at")).limit(most)
