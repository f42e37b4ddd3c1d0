"""Daily search and landing metrics: windows, totals, top queries, trends and opportunity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions.urls import domain_key, page_key, query_key
from skarv.sources.tables import latest, table

#: Keys and measures of the daily tables.
TABLES = {
    "gsc_page_daily": (["domain", "page", "date"], ["clicks", "impressions", "ctr", "position"]),
    "gsc_page_query_daily": (["domain", "page", "query", "date"], ["clicks", "impressions", "ctr", "position"]),
    "ga4_landing_page_daily": (["domain", "page", "date"], ["sessions", "conversions", "bounce_rate"]),
}


def upserted(spark: SparkSession, directory: str, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The table as an upsert by key leaves it: keys in normal form, the last delivery of each, within [since, until].

    The date range reaches the scan. NaN becomes null, as a database stores it. Rows without date, and query rows without query, are left out.
    """
    keys, values = TABLES[name]
    rows = table(spark, directory, name).select(*keys, *values, "ingested_at").filter(F.col("date").isNotNull())
    if since:
        rows = rows.filter(F.col("date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.filter(F.col("date") <= F.lit(until).cast("date"))
    rows = rows.withColumns({"domain": domain_key(F.col("domain")), "page": page_key(F.col("page"))})
    if "query" in keys:
        rows = rows.withColumn("query", query_key(F.col("query"))).filter(F.col("query") != "")
    doubles = [c for c in values if rows.schema[c].dataType.typeName() == "double"]
    rows = rows.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return latest(rows, keys, values)


def merge(existing: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Upsert: rows of both by key, new values winning, but for the columns in `keep`, which stay as they were (created_at).

    Keys are unique on either side; null keys match each other. Columns are those of existing.
    """
    o, n = existing.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    here = F.col("n._new").isNotNull()
    both = o.withColumn("_old", F.lit(1)).alias("o").join(n.withColumn("_new", F.lit(1)).alias("n"), on, "full_outer")

    def pick(c: str) -> Column:
        if c in keep:
            return F.when(F.col("o._old").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[pick(c) for c in existing.columns])


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing and the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def with_ids(existing: DataFrame, new: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """new with ids that go on after those of existing, in `order`. For small tables of headers: it numbers in one task."""
    start = F.coalesce(existing.agg(F.max(id_column)).scalar(), F.lit(0))
    return new.withColumn(id_column, (F.row_number().over(Window.orderBy(*order)) + start).cast("long"))


def page_totals(rows: DataFrame) -> DataFrame:
    """domain, page, clicks, impressions, ctr, position, days: sums, and plain means over rows (not weighted)."""
    return rows.groupBy("domain", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("ctr").alias("ctr"), F.avg("position").alias("position"), F.count("*").alias("days"))


def query_totals(rows: DataFrame) -> DataFrame:
    """The same by domain, page and query."""
    return rows.groupBy("domain", "page", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.avg("ctr").alias("ctr"), F.avg("position").alias("position"))


def landing_totals(rows: DataFrame) -> DataFrame:
    """domain, page, sessions, conversions, bounce_rate, days."""
    return rows.groupBy("domain", "page").agg(F.sum("sessions").alias("sessions"), F.sum("conversions").alias("conversions"), F.avg("bounce_rate").alias("bounce_rate"), F.count("*").alias("days"))


def top_queries(rows: DataFrame, n: int = 5) -> DataFrame:
    """Totals of the n queries of each page with most impressions, with rank_no; ties by query."""
    totals = query_totals(rows)
    rank = F.row_number().over(Window.partitionBy("domain", "page").orderBy(F.col("impressions").desc_nulls_last(), "query"))
    return totals.withColumn("rank_no", rank).filter(F.col("rank_no") <= n)


def page_trend(rows: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """domain, page, recent, before, recent_rows: clicks of the last `days` days and of as many before, in one pass."""
    recent = F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)
    before = (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 2 * days)) & ~recent
    return rows.groupBy("domain", "page").agg(
        F.coalesce(F.sum(F.when(recent, F.col("clicks"))), F.lit(0)).alias("recent"),
        F.coalesce(F.sum(F.when(before, F.col("clicks"))), F.lit(0)).alias("before"),
        F.count_if(recent).alias("recent_rows"),
    )


def uncovered_queries(rows: DataFrame, least_pair: int = 50, least: int = 100) -> DataFrame:
    """domain, query, impressions, page, position: queries that pages show for but get no clicks from, with the page shown most.

    Pairs of page and query with no click and `least_pair` impressions, added up by query; of pages with equal impressions the
    alphabetically last.
    """
    pairs = query_totals(rows).filter((F.coalesce("clicks", F.lit(0)) == 0) & (F.col("impressions") >= least_pair))
    best = F.max(F.struct("impressions", "page", "position"))
    return pairs.groupBy("domain", "query").agg(F.sum("impressions").alias("impressions"), best.alias("b")).filter(F.col("impressions") >= least).select("domain", "query", "impressions", F.col("b.page").alias("page"), F.col("b.position").alias("position"))


def page_overview(pages: DataFrame, queries: DataFrame, landings: DataFrame, n: int = 5) -> DataFrame:
    """domain, page, search and landing totals and the top queries as one text; pages of either table, in one grouped join."""
    tops = top_queries(queries, n).groupBy("domain", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "query"))), lambda x: x["query"]), ", ").alias("queries"))
    search = page_totals(pages).select("domain", "page", "clicks", "impressions")
    landing = landing_totals(landings).select("domain", "page", "sessions", "conversions")
    return search.join(landing, ["domain", "page"], "full_outer").join(tops, ["domain", "page"], "left")


#: The kinds of opportunities.
KINDS = ["high-impressions-low-ctr", "near-page-one", "traffic-down", "high-traffic-low-conversion", "query-gap"]


def opportunities(pages: DataFrame, queries: DataFrame, landings: DataFrame, as_of: str, least: dict[str, float] | None = None) -> DataFrame:
    """domain, kind, subject, level, measure: pages and queries worth a look. Thresholds are parameters (`least`).

    Five filters over four aggregates, put together by union; nothing is sorted or cut.
    """
    p = {"impressions": 500, "ctr": 0.03, "position": 10, "near_low": 11, "near_high": 20, "near_impressions": 100, "prior_clicks": 50, "drop": 0.7, "sessions": 200, "rate": 0.01, "pair": 50, "query": 100} | (least or {})
    totals = page_totals(pages)
    trend = page_trend(pages, as_of)
    landing = landing_totals(landings)
    gaps = uncovered_queries(queries, p["pair"], p["query"])
    row = lambda df, kind, subject, level, measure: df.select("domain", F.lit(kind).alias("kind"), F.col(subject).alias("subject"), level.alias("level"), measure.cast("double").alias("measure"))
    parts = [
        row(totals.filter((F.col("impressions") >= p["impressions"]) & (F.col("ctr") < p["ctr"]) & (F.col("position") <= p["position"])), KINDS[0], "page", F.when(F.col("impressions") >= 5000, 4).when(F.col("impressions") >= 2000, 3).otherwise(2), F.col("impressions")),
        row(totals.filter((F.col("position") >= p["near_low"]) & (F.col("position") <= p["near_high"]) & (F.col("impressions") >= p["near_impressions"])), KINDS[1], "page", F.when(F.col("position") <= 15, 3).otherwise(2), F.col("impressions")),
        row(trend.filter((F.col("recent_rows") > 0) & (F.col("before") >= p["prior_clicks"]) & (F.col("recent") < F.col("before") * p["drop"])), KINDS[2], "page", F.when(F.col("recent") * 2 <= F.col("before"), 4).otherwise(3), F.col("before") - F.col("recent")),
        row(landing.filter((F.col("sessions") >= p["sessions"]) & (F.col("conversions") < F.col("sessions") * p["rate"])), KINDS[3], "page", F.when(F.col("sessions") >= 1000, 4).otherwise(3), F.col("sessions")),
        row(gaps, KINDS[4], "query", F.when(F.col("impressions") >= 500, 3).otherwise(2), F.col("impressions")),
    ]
    return reduce(DataFrame.unionByName, parts)


def on_brand(query: Column, brand: Column, slug: Column) -> Column:
    """A word of the query contains, or is contained in, a brand or path word longer than two characters."""
    words = F.split(F.lower(query), r"\s+")
    relevant = F.filter(F.array_union(brand, slug), lambda r: F.length(r) > 2)
    return F.exists(words, lambda w: F.exists(relevant, lambda r: F.contains(w, r) | F.contains(r, w)))


def digest_lines(found: DataFrame, n: int = 10) -> DataFrame:
    """domain, lines: the n most urgent findings of each domain as one text; level, measure, kind and subject decide."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("level"), F.desc("measure"), "kind", "subject"))
    top = found.withColumn("r", rank).filter(F.col("r") <= n)
    line = F.concat(F.col("r").cast("string"), F.lit(". ["), F.col("kind"), F.lit("] "), F.col("subject"))
    return top.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
