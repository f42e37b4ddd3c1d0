"""Pages of audit runs as the text operators need them: counting rows, site and normal URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.urls import host_col, url_col
from skarv.sources.tables import latest


def run_sites(audit_runs: DataFrame) -> DataFrame:
    """run_id, site: the host of each run's target in its counting row. Runs without host are left out."""
    runs = latest(audit_runs.filter(F.col("id").isNotNull()), [F.col("id").alias("run_id")], ["target_url"])
    return runs.select("run_id", host_col(F.col("target_url")).alias("site")).filter(F.col("site").isNotNull())


def counting_pages(page_snapshots: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """run_id, crawl_seq and `columns` of the counting row of each page. Columns are made before the shuffle."""
    made = page_snapshots.select("run_id", "crawl_seq", "ingested_at", *[c.alias(n) for n, c in columns.items()])
    return latest(made, ["run_id", "crawl_seq"], list(columns))


def page_url() -> Column:
    return url_col(F.col("url"))
