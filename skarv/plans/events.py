"""Queries of sources and stream operators over tables at rest, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.operators import pages as P
from skarv.plans.pages import PAGES, url_sql
from skarv.sources import crawl as C
from skarv.sources import requests as Q
from skarv.sources.tables import table
from skarv.streaming import state as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    return T.rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86_400)


@query("SELECT user_id, max({'t': ts, 'v': event_type}).v AS event_type FROM events GROUP BY user_id")
def latest_progress(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_progress(table(spark, d, "events"), "user_id", "ts", "event_type")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    counts = T.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH r AS (SELECT id, CASE WHEN json_valid(request_json) THEN request_json END AS j FROM audit_runs), q AS (SELECT id, json_extract_string(j, '$.mode') AS mode, json_extract_string(j, '$.targetUrl') AS url, "
    "json_extract_string(j, '$.locale') AS locale, json_extract_string(j, '$.country') AS country, TRY_CAST(json_extract_string(j, '$.maxPages') AS INT) AS pages FROM r) "
    "SELECT id, coalesce(mode, 'domain') AS mode, url AS target_url, pages, CASE WHEN NOT coalesce(regexp_matches(trim(url), '(?i)^https?://'), false) THEN 'url' WHEN coalesce(mode, 'domain') NOT IN ('domain', 'page') THEN 'mode' "
    "WHEN length(coalesce(locale, 'nb-NO')) < 2 THEN 'locale' WHEN length(coalesce(country, 'NO')) <> 2 THEN 'country' WHEN coalesce(mode, 'domain') = 'domain' AND coalesce(pages, 150) NOT BETWEEN 10 AND 500 THEN 'pages' END AS problem FROM q"
)
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    return Q.run_requests(table(spark, d, "audit_runs"))


@query()
def crawl_depths(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(table(spark, d, "page_snapshots"), ["url", "discovered_from", "internal_links"])
    seeds = pages.filter("discovered_from = 'seed'").select("url")
    return C.crawl(seeds, pages.select(F.col("url").alias("src"), F.explode("internal_links").alias("dst")))


def _crawl_sql() -> str:
    host = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return (
        f"WITH RECURSIVE {PAGES}, links AS (SELECT url AS s, unnest(internal_links) AS t FROM pages), e AS (SELECT DISTINCT src, dst FROM (SELECT {url_sql('s')} AS src, {url_sql('t')} AS dst FROM links) "
        f"WHERE {host.format('src')} = {host.format('dst')} AND {host.format('dst')} <> '' AND NOT regexp_matches(dst, '{C.NO_PAGE}')), "
        f"r(url, depth) USING KEY (url) AS (SELECT DISTINCT {url_sql('url')} AS url, 0 AS depth FROM pages WHERE discovered_from = 'seed' UNION "
        "SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON e.src = r.url LEFT JOIN recurring.r AS k ON k.url = e.dst WHERE k.url IS NULL GROUP BY e.dst) "
        "SELECT url, CAST(depth AS INT) AS depth FROM r"
    )


SQL["crawl_depths"] = _crawl_sql()
