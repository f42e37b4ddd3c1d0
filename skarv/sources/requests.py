"""Audit requests: checked and completed, in Python for one and as columns for many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.urls import normalize_url

#: Defaults and bounds of a request.
LOCALE, COUNTRY, PAGES, LEAST, MOST = "nb-NO", "NO", 150, 10, 500


def check_request(request: dict) -> dict:
    """The request with defaults; ValueError says what is wrong with it. A page request has one page and no competitors."""
    url = normalize_url(str(request.get("targetUrl") or ""))
    if not url.startswith(("http://", "https://")):
        raise ValueError("targetUrl has to be an http(s) URL")
    mode = request.get("mode") or "domain"
    if mode not in ("domain", "page"):
        raise ValueError("mode has to be domain or page")
    locale, country = request.get("locale") or LOCALE, request.get("country") or COUNTRY
    if len(locale) < 2 or len(country) != 2:
        raise ValueError("locale needs two characters or more, country two")
    pages = request.get("maxPages", PAGES)
    if mode == "domain" and not (isinstance(pages, int) and not isinstance(pages, bool) and LEAST <= pages <= MOST):
        raise ValueError(f"maxPages has to be a whole number from {LEAST} to {MOST}")
    competitors = [normalize_url(u) for u in request.get("competitorUrls") or []]
    if any(not u.startswith(("http://", "https://")) for u in competitors):
        raise ValueError("competitorUrls have to be http(s) URLs")
    return {"mode": mode, "targetUrl": url, "locale": locale, "country": country, "competitorUrls": [] if mode == "page" else competitors, "maxPages": 1 if mode == "page" else pages}


def request_problem(mode: Column, url: Column, locale: Column, country: Column, pages: Column) -> Column:
    """What is wrong with a request, or null."""
    return (
        F.when(~F.coalesce(F.trim(url).rlike("(?i)^https?://"), F.lit(False)), "url")
        .when(~F.coalesce(mode, F.lit("domain")).isin("domain", "page"), "mode")
        .when(F.length(F.coalesce(locale, F.lit(LOCALE))) < 2, "locale")
        .when(F.length(F.coalesce(country, F.lit(COUNTRY))) != 2, "country")
        .when((F.coalesce(mode, F.lit("domain")) == "domain") & ~F.coalesce(pages, F.lit(PAGES)).between(LEAST, MOST), "pages")
    )


def run_requests(audit_runs: DataFrame) -> DataFrame:
    """id, mode, target_url, pages, problem of each run's request."""
    v = F.try_parse_json("request_json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = audit_runs.select("id", get("$.mode", "string").alias("mode"), get("$.targetUrl", "string").alias("url"), get("$.locale", "string").alias("locale"), get("$.country", "string").alias("country"), get("$.maxPages", "int").alias("pages"))
    problem = request_problem(F.col("mode"), F.col("url"), F.col("locale"), F.col("country"), F.col("pages"))
    return rows.select("id", F.coalesce("mode", F.lit("domain")).alias("mode"), F.col("url").alias("target_url"), "pages", problem.alias("problem"))
