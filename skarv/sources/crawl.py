"""Crawls over tables of fetched pages: sitemap levels, frontier rounds and link extraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.text import decode_entities
from skarv.functions.urls import host_col, url_col
from skarv.runtime import cut

#: File endings that are no pages.
NO_PAGE = r"(?i)\.(jpe?g|png|gif|webp|svg|ico|pdf|zip|gz|mp[34]|webm|avi|css|js|json|xml|txt|woff2?|ttf|docx?|xlsx?|pptx?)$"
#: Rounds after which a crawl's tables of single rounds become one.
MERGE = 20


def sitemap_urls(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """url: what the sitemaps reachable from seeds (url) list, in files (url, content).

    A file is read once. Of its locations those ending in .xml or .xml.gz are sitemaps of the next round, the others are
    results. Each round is one join; it ends when no sitemap is new, however deep they are nested or whether they name one another.
    """
    loc = files.select("url", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc")).select("url", decode_entities(F.col("loc")).alias("loc"))
    links = cut(loc.distinct(), "sitemap-links")
    level = seeds.select("url").distinct()
    seen, found = level, None
    for n in count(1):
        here = links.join(level, "url", "left_semi").select(F.col("loc").alias("url")).distinct()
        is_map = F.col("url").rlike(r"(?i)\.xml(\.gz)?$")
        pages = here.filter(~is_map)
        found = pages if found is None else found.unionByName(pages)
        level = cut(here.filter(is_map).join(seen, "url", "left_anti"), f"sitemap-{n}")
        if level.isEmpty():
            return found.distinct()
        seen = seen.unionByName(level)
        if n % MERGE == 0:
            seen, found = cut(seen, f"sitemap-seen-{n}"), cut(found.distinct(), f"sitemap-found-{n}")


def crawl(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """url, depth: pages reachable from seeds (url) over links (src, dst) within the seed's host, with their first depth.

    Breadth first: one join a round, the frontier without what was seen, until nothing new is reached. Every URL is in normal
    form. The frontier is written each round, and what was seen every MERGE rounds as one table, so plans stay short and lost
    executors cost one round.
    """
    edge = links.select(url_col(F.col("src")).alias("src"), url_col(F.col("dst")).alias("dst"))
    edge = cut(edge.filter((host_col(F.col("src")) == host_col(F.col("dst"))) & ~F.col("dst").rlike(NO_PAGE)).distinct(), "crawl-links")
    frontier = seeds.select(url_col(F.col("url")).alias("url")).distinct()
    seen = cut(frontier.withColumn("depth", F.lit(0)), "crawl-0")
    frontier = seen
    for depth in count(1):
        reached = edge.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = cut(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), f"crawl-{depth}")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % MERGE == 0:
            seen = cut(seen, f"crawl-seen-{depth}")
